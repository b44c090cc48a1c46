"""The contract between extractors and the resolver."""

MATCHES = (
    "match_type string, file string, captures map<string,array<string>>, owner_function string, owner_line int, owner_class string, "
    "scope_id string, start_line int, end_line int, start_byte int, end_byte int, is_test boolean, seq int"
)
# Kinds of matches.
KINDS = (
    "FUNCTION_DEF CLASS_DEF IMPORT REEXPORT CALL ARGUMENT PARAMETER RETURN_VALUE VARIABLE_TYPE VARIABLE_STATE ALIAS DESTRUCTURE ROUTE DATABASE_OP ERROR LITERAL CONTRACT HTTP_CALL CONSTANT"
).split()
