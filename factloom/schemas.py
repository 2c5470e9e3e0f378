"""Schemas of the fact tables an extractor supplies (Spark DDL).

Ids of calls and of ``new`` expressions in ``calls`` and ``args`` are those of
their rows in ``exprs``. Edges of ``expr_edges`` carry the child's role:
``receiver`` of a method call, ``operand`` that can be the parent's value.
``match_arms.cond_dnf`` is the guard of the arm on the parameter that a callable
narrows, ``return_sites.narrowed_type_json`` that parameter's type at the return.
A class constant has its class in ``prop`` and its name in ``member``. The body
of a closure is the method ``{closure}:LINE`` without a class.
"""

from __future__ import annotations

FACTS: dict[str, str] = {
    "files": "file string, root string, is_vendor boolean",
    "classes": "class string, file string, is_enum boolean, is_backed boolean, ctor_readable boolean",
    "class_closure": "sub string, super string",
    "class_methods": "class string, method string, declaring_class string, written_in_file string, declaring_file string, start_line int",
    "methods": "class string, method string, file string, always_terminates boolean",
    "params": "class string, method string, idx int, name string, variadic boolean, by_ref boolean, default_const string",
    "calls": "call_id long, file string, class string, method string, pos long, line int, kind string, callee_name string, receivers array<string>, is_first_class boolean",
    "args": "call_id long, ord int, name string, unpack boolean, expr_id long, var_name string, const string",
    "exprs": "expr_id long, kind string, type_json string, const struct<v: string>, is_null string, var_name string, prop string, member string, scope_class string, scope_fn string",
    "expr_edges": "parent long, ord int, child long, role string",
    "return_sites": "file string, class string, method string, ord int, pos long, line int, expr_id long, narrowed_type_json string",
    "match_arms": "expr_id long, ord int, cond_dnf array<array<string>>, is_default boolean, body_expr_id long, pos long",
    "throw_points": "file string, class string, method string, ord int, line int, is_literal boolean, explicit boolean, types array<string>, call_id long",
    "local_writes": "file string, scope_key string, var string, ord int, expr_id long, retires boolean, opaque boolean, pos long",
    "array_items": "expr_id long, ord int, key string, value_expr long",
    "header_writes": "file string, class string, method string, var string, pos long, header string, value string",
    "enum_cases": "enum string, ord int, case string, value string",
    "attributes": "class string, method string, ord int, name string, arg0 string, file string, line int",
    "properties": "class string, ord int, name string, native_type_json string, param_type_json string, var_type_json string, is_static boolean, is_promoted boolean, source string",
    "closures": "file string, line int, ord int, always_terminates boolean",
    "registry": "kind string, name string, ord int, exception string, fixed_status int, status_arg int",
}
