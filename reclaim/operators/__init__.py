from reclaim.operators.tree import (scan_roots, DirTest, named, dir_path_glob, dir_name_glob, dir_path_regex,
                                    under_dir, contents_of, subtree_of, matching_ancestors, dir_contents,
                                    mark_under_dirs, marked_dirs, under_marked_dirs)
from reclaim.operators.retention import (over_budget, drop_all_but_latest, drop_last_n, superseded,
                                         before_current, unreferenced, freed_between, join_on_keys)
from reclaim.operators.rules import (ListingStep, Rule, RuleBook, all_hits, first_match, first_match_name,
                                     first_match_seq, reachable, union_steps, union_step_frames, prepare_all)
from reclaim.operators.selection import (SelectionError, check_mode, requested, unknown_names,
                                         ordered_catalogue, select_rules, selected_names, answers, approval_gate, host_capabilities,
                                         tool_gate, with_host_tools, ToolBits, applicable_rules)
from reclaim.operators.report import (reclaim_by_rule, with_grand_total, run_report, max_over_run,
                                      capped_share, TOTAL_LABEL)
from reclaim.operators.order import global_row_number
from reclaim.operators.tree import DirFlag, mark_dirs
from reclaim.operators.labels import DirTree
from reclaim.operators.rule_index import Where
