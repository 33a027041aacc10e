"""Schemas of inputs, events and stores, as Spark DDL."""

C_FILES = "file_idx long, path string, abs_path string, raw string"
VIEWS = "file_idx long, path string, raw string, min string, pp_user string, line_map array<int>"
COMPILE_COMMANDS = "directory string, file string, command string, arguments array<string>"
SUPPRESS_RULES = "path string, category string, is_glob boolean, regex string"
MARKERS = "file_idx long, path string, line int, kind string"
MAN_PAGES = "name string, section string, raw string"
RULES = "name string, flags int"
#: One row for each event of a file; which columns are set depends on kind: call, close, clear, env, alloc.
EVENTS = (
    "file_idx long, path string, kind string, seq int, line int, column int, function string, e_kind string, p_kind string, void_cast boolean, in_condition boolean, "
    "arg_kinds array<string>, store_var string, in_block boolean, checked_later boolean, func_id int, var string, terminal boolean"
)
FINDINGS = "file_idx long, path string, seq long, line int, column int, symbol string, category string, kind string, message string, issue_format boolean"
FUNCTIONS = "id long, name string, section string, short_name string, short_desc string, header string, proto string, man_source string, raw string"
FUNCTION_SECTIONS = "id long, function_id long, section_name string, content string, ord int"
FUNCTION_ALIASES = "id long, function_id long, alias_name string"
RUNS = "id long, filename string, ts timestamp, error_count int"
FACTS = "id long, run_id long, kind string, symbol string, line int, details string"
FACT_TERMS = "fact_id long, column string, pos int, term string"
