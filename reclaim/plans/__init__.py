from reclaim.plans.catalogue import file_rulebook, file_rules, rule_roots, rulebook
from reclaim.plans.run import RunResult, run
