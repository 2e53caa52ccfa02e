"""The engine's own queries and, for each that SQL can express, the same result as SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import workloads as W

NAMES = (
    "props_get_k", "props_get_k_strict", "props_sum_by_type", "props_type", "props_valid", "order_pointer_first_line", "order_path_native", "order_wildcard_sum", "order_wildcard_each",
    "order_pointers", "accessor_depths", "accessor_checked", "in_string_number", "text_round_trip", "quote_text", "orders_doc_explode", "customer_partial", "customer_selector", "customer_fields",
    "find_order", "top_order_last_tie", "distinct_keys_union", "distinct_keys_pointer", "brand_ratings", "points", "region_nation_nested", "extract_subset", "bound_rows", "nodes_count_by_kind",
    "nodes_statistics", "nodes_subtree", "object_each", "sizes", "key_lookups", "minify_roundtrip", "prettify_regions", "fractured_regions", "fractured_round_trip", "msgpack_sizes", "tape_words",
    "utf8_check", "html_round_trip", "conversation_streams", "files_newline", "files_whitespace", "files_by_range", "chunked_turns", "number_struct", "typed_getters", "document_ends", "stream_errors", "stream_truncated", "kind_tests", "raw_texts", "bad_documents", "pointer_cases", "path_cases", "number_cases", "wildcard_cases", "unescape_cases", "touched_cases",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(W, name) for name in NAMES}


def _text(v: object) -> str:
    """A value as a SQL literal."""
    if v is None:
        return "cast(null as varchar)"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    parts = []
    for piece in v.replace("'", "''").replace("\n", "\0n").replace("\t", "\0t").split("\0"):
        parts.append(f"'{piece}'" if not parts else f"chr({10 if piece[0] == 'n' else 9}) || '{piece[1:]}'")
    return " || ".join(parts)


def _values(rows: list[tuple], *names: str) -> str:
    """A table of literals, as one select a row."""
    return " union all ".join("select " + ", ".join(f"{_text(v)} as {n}" for v, n in zip(row, names, strict=True)) for row in rows)


def oracle_sql() -> dict[str, str]:
    line = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag"
    first = f"(select l_orderkey, v from (select l_orderkey, {{0}} as v, row_number() over ({line}) as turn from lineitem) where turn = 1)"
    lines = "(select l_orderkey, count(*) as n, sum(l_quantity) as q, sum(l_partkey) as p from lineitem group by l_orderkey)"
    nth = f"(select l_orderkey, {{0}} as v, row_number() over ({line}) as turn from lineitem)"
    pretty_region = """'{' || chr(10) || '    "name": "' || r_name || '",' || chr(10) || '    "nations": [' || chr(10) ||
      string_agg('        {' || chr(10) || '            "key": ' || n_nationkey || ',' || chr(10) || '            "name": "' || n_name || '"' || chr(10) || '        }', ',' || chr(10) order by n_nationkey)
      || chr(10) || '    ]' || chr(10) || '}'"""
    fractured_region = """'{' || chr(10) || '    "name": "' || r_name || '",' || chr(10) || '    "nations": [' || chr(10) ||
      string_agg('        { "key": ' || n_nationkey || repeat(' ', cast(w - length(cast(n_nationkey as varchar)) as integer)) || ', "name": "' || n_name || '" }', ',' || chr(10) order by n_nationkey)
      || chr(10) || '    ]' || chr(10) || '}'"""
    customers = "select c_custkey, c_name, c_acctbal, cast(null as varchar) as error from customer"
    return {
        "files_newline": customers,
        "files_whitespace": customers,
        "files_by_range": customers,
        "chunked_turns": "select conv_id, turn, role, cast(length(text) as integer) as n, cast(null as varchar) as error from conversations",
        "number_struct": """select p_partkey, case p_partkey % 3 when 0 then 'int64' when 1 then 'double' else 'uint64' end as kind, case when p_partkey % 3 = 0 then cast(p_size as bigint) end as i64,
            case when p_partkey % 3 = 2 then '18446744073709551615' end as u64, case when p_partkey % 3 = 1 then p_retailprice end as f64 from part""",
        "kind_tests": """select c_custkey, true as object, false as scalar, true as string, c_custkey % 3 <> 0 as nothing, true as number, true as integer, c_acctbal < 0 as negative from customer""",
        "raw_texts": """select c_custkey, '{"id":' || c_custkey || ',"screen_name":"' || c_name || '"}' as object, '"' || c_mktsegment || '"' as text,
            case when c_custkey % 3 = 0 then cast(c_nationkey as varchar) else 'null' end as reply, cast(c_custkey as varchar) as id from customer""",
        "props_get_k": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
        "props_get_k_strict": "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(null as varchar) as error from events",
        "props_sum_by_type": "select event_type, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as sum_k, count(*) as n from events group by event_type",
        "props_type": "select event_id, case json_type(props, '$.k') when 'UBIGINT' then 'int64' when 'BIGINT' then 'int64' when 'DOUBLE' then 'double' else lower(json_type(props, '$.k')) end as kind from events",
        "props_valid": "select event_id, json_valid(props) as valid from events",
        "order_pointer_first_line": f"select o_orderkey, v as partkey from orders join {first.format('l_partkey')} f on o_orderkey = l_orderkey",
        "order_path_native": f"select o_orderkey, o_custkey as custkey, v as quantity from orders join {first.format('l_quantity')} f on o_orderkey = l_orderkey",
        "order_wildcard_sum": f"select o_orderkey, q as quantity, cast(n as integer) as n from orders join {lines} s on o_orderkey = l_orderkey",
        "order_wildcard_each": f"select o_orderkey, cast(row_number() over ({line}) - 1 as integer) as ord, l_partkey as partkey from orders join lineitem on o_orderkey = l_orderkey",
        "order_pointers": f"""with d as (select o_orderkey, o_orderpriority from orders join {lines} s on o_orderkey = l_orderkey)
            select o_orderkey, '/o_orderkey' as pointer, cast(o_orderkey as varchar) as value, cast(null as varchar) as error from d
            union all select o_orderkey, '/priority/text', '"' || o_orderpriority || '"', null from d
            union all select o_orderkey, '/lines/999', null, 'INDEX_OUT_OF_BOUNDS' from d union all select o_orderkey, '/nothing', null, 'NO_SUCH_FIELD' from d""",
        "accessor_depths": f"select o_orderkey, o_orderstatus as one, o_orderpriority as two, v as three from orders join {first.format('l_returnflag')} f on o_orderkey = l_orderkey",
        "accessor_checked": f"select o_orderkey, 'customer ' || o_custkey as name from orders join {lines} s on o_orderkey = l_orderkey",
        "in_string_number": "select o_orderkey, o_totalprice as price, o_custkey as custkey from orders",
        "text_round_trip": "select doc_id, sha256(text) as digest from documents",
        "quote_text": "select doc_id, sha256(text) as digest from documents",
        "orders_doc_explode": "select o_orderkey, l_linenumber as linenumber, l_partkey as partkey, l_quantity as quantity from orders join lineitem on o_orderkey = l_orderkey",
        "customer_partial": "select c_custkey as id, c_name as name, c_mktsegment as text, case when c_custkey % 3 = 0 then c_nationkey end as reply, c_acctbal as retweets from customer",
        "customer_selector": "select c_custkey, 3 as matched, '\"' || c_mktsegment || '\"' as text, case when c_custkey % 3 = 0 then cast(c_nationkey as varchar) else 'null' end as reply from customer",
        "customer_fields": "select c_custkey, c_mktsegment as text, c_acctbal as retweets from customer",
        "find_order": f"select o_orderpriority as text, o_custkey as custkey from orders join {lines} s on o_orderkey = l_orderkey where o_orderkey = 33 limit 1",
        "top_order_last_tie": f"select o_orderkey as orderkey, o_totalprice as price, o_orderpriority as text from orders join {lines} s on o_orderkey = l_orderkey where o_totalprice <= 200000 order by o_totalprice desc, o_orderkey desc limit 1",
        "distinct_keys_union": "select o_custkey as id from orders where o_orderkey in (select l_orderkey from lineitem) union select l_suppkey from lineitem where l_orderkey in (select o_orderkey from orders)",
        "distinct_keys_pointer": f"""select o_custkey as id from orders where o_orderkey in (select l_orderkey from lineitem)
            union select v from orders join {nth.format('l_suppkey')} n on o_orderkey = l_orderkey where turn in (1, 3)""",
        "brand_ratings": "select p_brand as brand, round(sum(p_retailprice * p_size), 2) as weighted, cast(sum(p_size) as bigint) as sizes from part group by p_brand",
        "points": "select vec_id, embedding[1] as x, embedding[2] as y, embedding[3] as z from embeddings",
        "region_nation_nested": "select r_regionkey as regionkey, false as leak, r_name as region, n_nationkey as nationkey, n_name as nation from region join nation on r_regionkey = n_regionkey",
        "extract_subset": "select s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"s_nationkey\":' || s_nationkey || '}' as json from supplier",
        "bound_rows": "select p_partkey, case when p_partkey % 5 <> 0 then p_size end as size, cast(null as varchar) as brand, case when p_partkey % 5 = 0 then 'NO_SUCH_FIELD' end as error from part",
        "nodes_count_by_kind": f"""with d as (select o_orderkey, n from orders join {lines} s on o_orderkey = l_orderkey)
            select 'object' as kind, cast(sum(3 + n) as bigint) as n from d union all select 'array', count(*) from d union all select 'string', cast(sum(3 + n) as bigint) from d
            union all select 'int64', cast(sum(2 + 3 * n) as bigint) from d union all select 'double', cast(sum(1 + 2 * n) as bigint) from d""",
        "nodes_statistics": f"""select o_orderkey as doc_id, 2 + 3 * n as integer_count, 1 + 2 * n as float_count, 3 + n as object_count, cast(1 as bigint) as array_count, 3 as maximum_depth, cast(n as integer) as maximum_array_size,
            9 + 6 * n as key_count, 9 + 6 * n - 15 as repeated_key_count, cast(0 as bigint) as null_count from orders join {lines} s on o_orderkey = l_orderkey""",
        "nodes_subtree": f"select o_orderkey as doc_id, 1 + 7 * n as n, cast(p as bigint) as partkeys from orders join {lines} s on o_orderkey = l_orderkey",
        "object_each": """select c_custkey, 0 as ord, 'user' as key, 'object' as kind from customer union all select c_custkey, 1, 'text', 'string' from customer
            union all select c_custkey, 2, 'in_reply_to', case when c_custkey % 3 = 0 then 'int64' else 'null' end from customer union all select c_custkey, 3, 'retweets', 'double' from customer""",
        "sizes": f"select o_orderkey, cast(n as integer) as lines, 6 as fields, 2 as slots from orders join {lines} s on o_orderkey = l_orderkey",
        "key_lookups": "select c_custkey, '\"' || c_mktsegment || '\"' as any_case, 'NO_SUCH_FIELD' as exact, '\"' || c_mktsegment || '\"' as in_order, 'NO_SUCH_FIELD' as behind from customer",
        "minify_roundtrip": f"select o_orderkey, true as strict, true as native, cast(14 + 8 * n as integer) as lines from orders join {lines} s on o_orderkey = l_orderkey",
        "prettify_regions": f"select r_regionkey, {pretty_region} as text from region join nation on r_regionkey = n_regionkey group by r_regionkey, r_name",
        "fractured_regions": f"""with n as (select r_regionkey, r_name, n_nationkey, n_name, max(length(cast(n_nationkey as varchar))) over (partition by r_regionkey) as w from region join nation on r_regionkey = n_regionkey)
            select r_regionkey, {fractured_region} as text from n group by r_regionkey, r_name""",
        "fractured_round_trip": f"select o_orderkey, true as same from orders join {lines} s on o_orderkey = l_orderkey",
        "msgpack_sizes": "select r_regionkey, cast(1 + 4 + 9 + 5 + 1 + length(r_name) as integer) as size from region",
        "tape_words": """select r_regionkey, 'root // pointing to 7|{ // pointing to 7|string "key"|integer ' || r_regionkey || '|string "name"|string "' || r_name || '"|} // pointing to 1|root // pointing to 0' as words from region""",
        "utf8_check": "select doc_id, true as good, false as cut from documents",
        "html_round_trip": "select page_id, url, cast(length(html) as integer) as n_html from pages",
        "conversation_streams": "select conv_id, count(*) as n, true as same, max(turn) as last from conversations group by conv_id",
        "typed_getters": """select p_partkey, cast(cast(p_retailprice as float) as double) as float, p_size > 25 as bool, case when p_partkey % 4 <> 0 or p_partkey = 0 then p_partkey end as uint32,
            case when p_partkey % 4 = 0 and p_partkey > 0 then 'NUMBER_OUT_OF_RANGE' end as uint32_error, case when p_partkey % 4 = 0 and p_partkey > 0 then 'NUMBER_OUT_OF_RANGE' end as uint64_error, '1234567890123456789012' || p_partkey as bigint,
            'INCORRECT_TYPE' as wrong, cast(p_partkey as varchar) as second, 'INDEX_OUT_OF_BOUNDS' as third, p_partkey % 2 = 1 as empty from part""",
        "document_ends": """select n_nationkey, true as bare, n_nationkey % 2 = 1 as trailing, case when n_nationkey % 2 = 1 then 'TAPE_ERROR' end as error, 'TAPE_ERROR' as code,
            cast(2 + length(cast(n_nationkey as varchar)) as integer) as at, case when n_nationkey < 10 then 'UNCLOSED_STRING' else 'TAPE_ERROR' end as cut, 'DEPTH_ERROR' as depth from nation""",
        "stream_errors": """with c as (select c_nationkey as nation, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i, count(*) over (partition by c_nationkey) as n,
              length('{"k":' || c_custkey || ',"n":"' || c_name || '"}') + 1 as size from customer)
            select nation, least(any_value(n), nation + 1) as n, cast(coalesce(sum(size) filter (i < least(nation, n - 1)), 0) as bigint) as last, case when nation < any_value(n) then 'N_ATOM_ERROR' end as error,
              any_value(n) as all, cast(nation < any_value(n) as bigint) as bad from c group by nation""",
        "stream_truncated": """select c_nationkey as nation, count(*) - 1 as documents, cast(max_by(length('{"k":' || c_custkey || ',"n":"' || c_name || '"}'), c_custkey) - 4 as bigint) as truncated
            from customer group by c_nationkey""",
        "bad_documents": _values([(i, e) for i, (_, e) in enumerate([*W.BAD, *((t, None) for t in W.GOOD)])], "case_id", "error"),
        "pointer_cases": _values([(i, v, e) for i, (_, v, e) in enumerate(W.POINTERS)], "case_id", "value", "error"),
        "path_cases": _values([(i, p) for i, (_, p) in enumerate(W.PATHS)], "case_id", "pointer"),
        "number_cases": _values([(i, *rest) for i, (_, *rest) in enumerate(W.NUMBERS)], "case_id", "kind", "i64", "u64", "i32"),
        "wildcard_cases": _values([(i, *rest) for i, (_, *rest) in enumerate(W.WILDCARDS)], "case_id", "n", "error").replace("cast(null as varchar) as n,", "cast(null as integer) as n,"),
        "unescape_cases": _values([(i, *rest) for i, (_, *rest) in enumerate(W.ESCAPES)], "case_id", "strict", "replaced"),
        "touched_cases": _values([(i, *rest) for i, (_, *rest) in enumerate(W.TOUCHED)], "case_id", "coarse", "value", "error", "whole"),
    }
