from reclaim.sources.tables import (read_table, inventory_from_events, load_inventory, read_inventory, store_inventory, write_inventory, directories,
                                   with_directories, ancestors, union_apart, INVENTORY_COLUMNS)
from reclaim.sources.listings import (csv_field, ws_field, explode_lines, json_env_names, regex_all, read_lines,
                                     read_documents)
from reclaim.sources.sinks import write_plan, write_report, read_plan, scratch_path
