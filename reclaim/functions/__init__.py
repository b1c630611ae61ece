from reclaim.functions.paths import (base_name, parent_dir, path_parts, depth_below, below,
                                    at_or_below, glob_body, glob_to_regex, glob_to_like, glob_match)
from reclaim.functions.predicates import (kind_in, name_in, name_glob_any, path_glob, not_under,
                                         age_days_over, size_over, depth_is, contains_any,
                                         older_than, before_day_boundary, protect, line_matches,
                                         ts_ntz, any_of, all_of, MIB)
from reclaim.functions.format import (format_bytes, format_duration, status_label, size_label,
                                     result_message)
from reclaim.functions.version import version_key
from reclaim.functions.text import lines, field, trim_chars, lower, is_yes
