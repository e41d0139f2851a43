"""The query set: one entry for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import aggs, hybrid, ingest, percolate, pipeline
from ..sources import writes
from ..streaming import jobs
from .catalogue import found, hits, register, rounded, table

# ---- filters --------------------------------------------------------------------------------------------------------

O = ("o_orderkey", "o_orderstatus", "o_totalprice")


def flt(name, query, where, index="orders", cols=O, extra=""):
    register(name, f"{index} {extra}", found(index, query, *cols), f"SELECT {', '.join(cols)} FROM {index} WHERE {where}")


register("match_all_count", "lineitem", lambda e: e.count("lineitem"), "SELECT count(*) AS count FROM lineitem")
flt("match_none", {"match_none": {}}, "false")
flt("term_keyword", {"term": {"o_orderstatus": "F"}}, "o_orderstatus = 'F'")
flt("term_case_insensitive", {"term": {"o_orderstatus": {"value": "f", "case_insensitive": True}}}, "lower(o_orderstatus) = 'f'")
flt("term_numeric", {"term": {"l_quantity": 17}}, "l_quantity = 17", "lineitem", ("l_orderkey", "l_linenumber"))
flt("terms_in", {"terms": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')")
flt("ids", {"ids": {"values": ["1", "5", "7"]}}, "o_orderkey IN (1, 5, 7)")
flt("range_num", {"range": {"l_quantity": {"gte": 10, "lt": 20}}}, "l_quantity >= 10 AND l_quantity < 20", "lineitem", ("l_orderkey", "l_linenumber", "l_quantity"))
flt("range_date_math", {"range": {"o_orderdate": {"gte": "1997-01-01||+1M/M", "lte": "1997-06||/M"}}}, "o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate <= TIMESTAMP '1997-06-30 23:59:59.999'")
flt("bool_must_should_not", {"bool": {"must": [{"term": {"o_orderstatus": "O"}}], "filter": [{"range": {"o_totalprice": {"gt": 1000}}}], "must_not": [{"term": {"o_orderpriority": "5-LOW"}}], "should": [{"match_all": {}}]}}, "o_orderstatus = 'O' AND o_totalprice > 1000 AND o_orderpriority <> '5-LOW'")
flt("bool_msm_pct", {"bool": {"should": [{"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gt": 100000}}}, {"prefix": {"o_orderpriority": "1"}}], "minimum_should_match": "67%"}}, "(o_orderstatus = 'F')::INT + (o_totalprice > 100000)::INT + (o_orderpriority LIKE '1%')::INT >= 2")
flt("exists_field", {"exists": {"field": "o_orderdate"}}, "o_orderdate IS NOT NULL")
flt("prefix", {"prefix": {"p_brand": "Brand#1"}}, "starts_with(p_brand, 'Brand#1')", "part", ("p_partkey", "p_brand"))
flt("wildcard", {"wildcard": {"p_type": "*A*"}}, "p_type LIKE '%A%'", "part", ("p_partkey", "p_type"))
flt("regexp", {"regexp": {"p_brand": "Brand#[12]."}}, "regexp_full_match(p_brand, 'Brand#[12].')", "part", ("p_partkey", "p_brand"))
flt("fuzzy", {"fuzzy": {"c_mktsegment": {"value": "BUILDIGN", "fuzziness": 2}}}, "damerau_levenshtein(c_mktsegment, 'BUILDIGN') <= 2", "customer", ("c_custkey", "c_mktsegment"))
flt("script_filter", {"script": {"script": {"source": "doc['l_extendedprice'].value * (1 - doc['l_discount'].value) > params.x", "params": {"x": 50000}}}}, "l_extendedprice * (1 - l_discount) > 50000", "lineitem", ("l_orderkey", "l_linenumber"))
flt("terms_set", {"terms_set": {"text": {"terms": ["the", "of", "and"], "minimum_should_match_script": {"source": "2"}}}}, "(list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), 'the'))::INT + (list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), 'of'))::INT + (list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), 'and'))::INT >= 2", "documents", ("doc_id",))
flt("wrapper", {"wrapper": {"query": "eyJ0ZXJtIjogeyJvX29yZGVyc3RhdHVzIjogIlAifX0="}}, "o_orderstatus = 'P'")
flt("constant_score", {"constant_score": {"filter": {"term": {"o_orderstatus": "P"}}, "boost": 2}}, "o_orderstatus = 'P'")
flt("query_string", {"query_string": {"query": "o_orderstatus:F AND o_totalprice:[1000 TO 50000]"}}, "o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000")

TOK = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')"
D = ("doc_id", "lang")
flt("match_or", {"match": {"text": "river stone"}}, f"list_has_any({TOK}, ['river', 'stone'])", "documents", D)
flt("match_and", {"match": {"text": {"query": "the and", "operator": "and"}}}, f"list_has_all({TOK}, ['the', 'and'])", "documents", D)
flt("match_msm", {"match": {"text": {"query": "the of and in", "minimum_should_match": "75%"}}}, " + ".join(f"list_contains({TOK}, '{w}')::INT" for w in ("the", "of", "and", "in")) + " >= 3", "documents", D)
flt("match_phrase", {"match_phrase": {"text": "of the"}}, f"contains(' ' || array_to_string({TOK}, ' ') || ' ', ' of the ')", "documents", D)
flt("text_prefix", {"prefix": {"text": "wa"}}, f"len(list_filter({TOK}, lambda x: starts_with(x, 'wa'))) > 0", "documents", D)
flt("match_part_name", {"match": {"p_name": "red"}}, "list_contains(string_split(lower(p_name), ' '), 'red')", "part", ("p_partkey", "p_name"))
flt("multi_match", {"multi_match": {"query": "the", "fields": ["text", "lang"]}}, f"list_contains({TOK}, 'the') OR lang = 'the'", "documents", D)
flt("simple_query_string", {"simple_query_string": {"query": "the +of -and", "fields": ["text"], "default_operator": "and"}}, f"list_contains({TOK}, 'the') AND list_contains({TOK}, 'of') AND NOT list_contains({TOK}, 'and')", "documents", D)
_LINE = f"' ' || array_to_string(list_filter({TOK}, lambda x: x <> ''), ' ') || ' '"
_RX = {
    "phrase_slop": " the ([^ ]+ ){0,2}of | of the ", "phrase_prefix": " of th", "match_bool_prefix": " the | riv", "span_near": " the ([^ ]+ ){0,3}of ",
    "span_first": "^ ([^ ]+ ){0,2}the ", "span_not": " the ", "intervals_ordered": " the ([^ ]+ ){0,4}of ", "combined_fields": " the | river ",
}
for _name, _q in {
    "phrase_slop": {"match_phrase": {"text": {"query": "the of", "slop": 2}}}, "phrase_prefix": {"match_phrase_prefix": {"text": "of th"}},
    "match_bool_prefix": {"match_bool_prefix": {"text": "the riv"}}, "span_near": {"span_near": {"clauses": [{"span_term": {"text": "the"}}, {"span_term": {"text": "of"}}], "slop": 3, "in_order": True}},
    "span_first": {"span_first": {"match": {"span_term": {"text": "the"}}, "end": 3}}, "span_not": {"span_not": {"include": {"span_term": {"text": "the"}}, "exclude": {"span_term": {"text": "of"}}}},
    "intervals_ordered": {"intervals": {"text": {"match": {"query": "the of", "max_gaps": 4, "ordered": True}}}}, "more_like_this": {"more_like_this": {"fields": ["text"], "like": [{"_id": "1"}], "min_term_freq": 1, "max_query_terms": 8}},
    "combined_fields": {"combined_fields": {"query": "the river", "fields": ["text"]}}, "common_terms": {"common": {"text": {"query": "the river", "cutoff_frequency": 0.5}}},
}.items():
    register(_name, "documents", found("documents", _q, "doc_id"), f"SELECT doc_id FROM documents WHERE regexp_matches({_LINE}, '{_RX[_name]}')" if _name in _RX else None)

flt("match_or_found", {"match": {"text": "the que"}}, f"list_has_any({TOK}, ['the', 'que'])", "documents", D)
# a term of over half the documents only counts where a rarer one matches
register("common_terms_found", "documents", found("documents", {"common": {"text": {"query": "the house que", "cutoff_frequency": 0.5}}}, "doc_id"), f"WITH d AS (SELECT doc_id, {TOK} AS t FROM documents), f AS (SELECT w, (SELECT count(*) FROM d WHERE list_contains(t, w)) > 0.5 * (SELECT count(*) FROM d) AS often FROM (VALUES ('the'), ('house'), ('que')) AS v(w)) SELECT doc_id FROM d WHERE list_has_any(t, (SELECT list(w) FROM f WHERE NOT often))")
register("anti_join_found", "customer orders", found("customer", {"bool": {"must_not": [{"has_child": {"index": "orders", "parent_field": "o_custkey", "id_field": "c_custkey", "query": {"term": {"o_orderstatus": "P"}}}}]}}, "c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")

# ---- sort, page, score ------------------------------------------------------------------------------------------------

register("topk_sort", "orders", hits("orders", {"sort": [{"o_totalprice": "desc"}], "size": 25}, *O), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
register("sort_paged", "orders", hits("orders", {"query": {"term": {"o_orderstatus": "O"}}, "sort": ["o_orderdate", {"o_totalprice": "desc"}], "from": 20, "size": 10}, *O), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
register("search_after_page", "orders", hits("orders", {"sort": [{"o_orderstatus": "asc"}], "search_after": ["F", 100], "size": 10}, *O), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND o_orderkey > 100) ORDER BY o_orderstatus, o_orderkey LIMIT 10")
register("collapse_best", "orders", hits("orders", {"sort": [{"o_totalprice": "desc"}], "collapse": {"field": "o_orderpriority"}, "size": 10}, "o_orderpriority", "o_orderkey"), "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
register("script_sort", "orders", hits("orders", {"sort": [{"_script": {"script": "doc['o_totalprice'].value % 1000", "order": "desc"}}], "size": 10}, "o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice % 1000 DESC, o_orderkey LIMIT 10")
register("post_filter_whole", "orders", hits("orders", {"query": {"range": {"o_totalprice": {"gt": 2000}}}, "post_filter": {"term": {"o_orderstatus": "P"}}, "sort": ["o_orderkey"], "size": None}, "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 2000 AND o_orderstatus = 'P' ORDER BY o_orderkey")
register("script_fields_whole", "orders", lambda e: rounded(e.search("orders", {"sort": ["o_orderkey"], "size": None, "script_fields": {"half": {"script": "doc['o_totalprice'].value / 2"}}}).select("o_orderkey", "half")), "SELECT o_orderkey, round(o_totalprice / 2, 4) AS half FROM orders ORDER BY o_orderkey")
register("source_filter_whole", "orders", lambda e: e.search("orders", {"sort": ["o_orderkey"], "size": None, "_source": {"includes": ["o_*"], "excludes": ["*date", "*priority"]}}).drop("_score"), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey")
register("slice_partition", "orders", hits("orders", {"slice": {"id": 1, "max": 4}, "sort": ["o_orderkey"], "size": None}, "o_orderkey"))
register("named_queries_whole", "orders", lambda e: e.search("orders", {"query": {"bool": {"should": [{"term": {"o_orderstatus": {"value": "F", "_name": "done"}}}, {"range": {"o_totalprice": {"gt": 100000, "_name": "big"}}}]}}, "sort": ["o_orderkey"], "size": None}).select("o_orderkey", F.array_join("matched_queries", ",").alias("names")), "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'done' END, CASE WHEN o_totalprice > 100000 THEN 'big' END], lambda x: x IS NOT NULL), ',') AS names FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 100000 ORDER BY o_orderkey")


def scored(name, index, query, sql, key, size=20, **body):
    register(name, index, lambda e: rounded(e.search(index, {"query": query, "size": size, **body}).select(key, "_score")), sql)


scored("function_score_fvf", "orders", {"function_score": {"field_value_factor": {"field": "o_totalprice", "factor": 0.5, "modifier": "log1p"}}}, "SELECT o_orderkey, round(log10(1 + o_totalprice * 0.5), 4) AS _score FROM orders ORDER BY log10(1 + o_totalprice * 0.5) DESC, o_orderkey LIMIT 20", "o_orderkey")
scored("decay_gauss", "orders", {"function_score": {"gauss": {"o_totalprice": {"origin": 50000, "scale": 10000, "decay": 0.5}}}}, "SELECT o_orderkey, round(exp(pow(abs(o_totalprice - 50000), 2) * ln(0.5) / pow(10000, 2)), 4) AS _score FROM orders ORDER BY abs(o_totalprice - 50000), o_orderkey LIMIT 20", "o_orderkey")
scored("decay_exp", "orders", {"function_score": {"exp": {"o_totalprice": {"origin": 50000, "scale": 10000}}}}, "SELECT o_orderkey, round(exp(ln(0.5) / 10000 * abs(o_totalprice - 50000)), 4) AS _score FROM orders ORDER BY abs(o_totalprice - 50000), o_orderkey LIMIT 20", "o_orderkey")
scored("decay_linear", "orders", {"function_score": {"linear": {"o_totalprice": {"origin": 50000, "scale": 10000}}}}, "SELECT o_orderkey, round(greatest(0, (20000 - abs(o_totalprice - 50000)) / 20000), 4) AS _score FROM orders ORDER BY abs(o_totalprice - 50000), o_orderkey LIMIT 20", "o_orderkey")
scored("script_score", "orders", {"script_score": {"query": {"term": {"o_orderstatus": "F"}}, "script": {"source": "Math.log(2 + doc['o_totalprice'].value)"}}}, "SELECT o_orderkey, round(ln(2 + o_totalprice), 4) AS _score FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "o_orderkey")
scored("rank_feature", "orders", {"rank_feature": {"field": "o_totalprice", "saturation": {"pivot": 1000}}}, "SELECT o_orderkey, round(o_totalprice / (o_totalprice + 1000), 4) AS _score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "o_orderkey")
scored("distance_feature", "orders", {"distance_feature": {"field": "o_totalprice", "origin": 20000, "pivot": 500}}, "SELECT o_orderkey, round(500 / (500 + abs(o_totalprice - 20000)), 4) AS _score FROM orders ORDER BY abs(o_totalprice - 20000), o_orderkey LIMIT 20", "o_orderkey")
scored("boosting", "orders", {"boosting": {"positive": {"match_all": {}}, "negative": {"term": {"o_orderstatus": "F"}}, "negative_boost": 0.2}}, "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END, 4) AS _score FROM orders ORDER BY 2 DESC, o_orderkey LIMIT 20", "o_orderkey")
scored("dis_max", "orders", {"dis_max": {"tie_breaker": 0.5, "queries": [{"term": {"o_orderstatus": {"value": "F", "boost": 3}}}, {"term": {"o_orderpriority": {"value": "1-URGENT", "boost": 2}}}]}}, "SELECT o_orderkey, round(a + 0.5::DOUBLE * b, 4) AS _score FROM (SELECT o_orderkey, greatest(x, y) AS a, least(x, y) AS b FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 3.0::DOUBLE ELSE 0 END AS x, CASE WHEN o_orderpriority = '1-URGENT' THEN 2.0::DOUBLE ELSE 0 END AS y FROM orders)) WHERE a > 0 ORDER BY 2 DESC, o_orderkey LIMIT 20", "o_orderkey")
scored("rescore_window", "orders", {"term": {"o_orderstatus": "F"}}, "SELECT o_orderkey, round(CASE WHEN rn <= 15 AND o_orderpriority = '1-URGENT' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END, 4) AS _score FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') ORDER BY 2 DESC, o_orderkey LIMIT 20", "o_orderkey", rescore={"window_size": 15, "query": {"rescore_query": {"term": {"o_orderpriority": "1-URGENT"}}, "rescore_query_weight": 2}}, sort=[{"_score": "desc"}])
_BM = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS a, count(*) FILTER (list_contains(w, 'the')) AS d FROM t WHERE len(w) > 0),
f AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS tf, len(w)::DOUBLE AS l FROM t WHERE list_contains(w, 'the'))
SELECT doc_id, round(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * l / a)), 4) AS _score FROM f, s
ORDER BY ln(1 + (n - d + 0.5) / (d + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * l / a)) DESC, doc_id LIMIT 20"""
scored("bm25_topk", "documents", {"match": {"text": "the"}}, _BM, "doc_id")

# ---- joins ------------------------------------------------------------------------------------------------------------

register("terms_lookup_semi", "orders customer", found("orders", {"terms": {"o_custkey": {"index": "customer", "query": {"term": {"c_mktsegment": "BUILDING"}}, "path": "c_custkey"}}}, "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
register("has_child", "orders lineitem", found("orders", {"has_child": {"index": "lineitem", "parent_field": "l_orderkey", "id_field": "o_orderkey", "min_children": 3, "query": {"range": {"l_quantity": {"gt": 25}}}}}, "o_orderkey"), "SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 25 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 HAVING count(*) >= 3")
register("has_parent", "lineitem orders", found("lineitem", {"has_parent": {"index": "orders", "id_field": "o_orderkey", "parent_field": "l_orderkey", "query": {"term": {"o_orderstatus": "P"}}}}, "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
register("anti_join", "customer orders", found("customer", {"bool": {"must_not": [{"has_child": {"index": "orders", "parent_field": "o_custkey", "id_field": "c_custkey", "query": {"match_all": {}}}}]}}, "c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
register("children_agg", "orders lineitem", lambda e: rounded(e.aggregate("orders", {"query": {"term": {"o_orderstatus": "F"}}, "aggs": {"lines": {"children": {"index": "lineitem", "parent_field": "l_orderkey", "id_field": "o_orderkey"}, "aggs": {"flag": {"terms": {"field": "l_returnflag"}, "aggs": {"qty": {"sum": {"field": "l_quantity"}}}}}}}})).drop("lines").withColumnRenamed("flag", "l_returnflag"), "SELECT l_returnflag, count(*) AS doc_count, round(sum(l_quantity), 4) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
register("children_under_terms", "orders lineitem", lambda e: rounded(e.aggregate("orders", {"aggs": {"status": {"terms": {"field": "o_orderstatus"}, "aggs": {"lines": {"children": {"index": "lineitem", "parent_field": "l_orderkey", "id_field": "o_orderkey"}, "aggs": {"most": {"max": {"field": "l_quantity"}}}}}}}})), "SELECT o_orderstatus AS status, 'lineitem' AS lines, count(*) AS doc_count, round(max(l_quantity), 4) AS most FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
register("parent_agg", "orders lineitem", lambda e: e.aggregate("lineitem", {"query": {"term": {"l_returnflag": "R"}}, "aggs": {"up": {"parent": {"index": "orders", "parent_field": "l_orderkey", "id_field": "o_orderkey"}, "aggs": {"status": {"terms": {"field": "o_orderstatus"}}}}}}).drop("up").withColumnRenamed("status", "o_orderstatus"), "SELECT o_orderstatus, count(*) AS doc_count FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")


def _nested(e):
    lines = e.index("lineitem").df.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag", "l_extendedprice")).alias("lines"))
    e.register("order_docs", lines, None, "l_orderkey")
    return e


_NQ = {"nested": {"path": "lines", "query": {"bool": {"must": [{"range": {"lines.l_quantity": {"gte": 45}}}, {"term": {"lines.l_returnflag": "R"}}]}}}}
register("nested_exists", "lineitem", lambda e: _nested(e).filtered("order_docs", _NQ).select("l_orderkey"), "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
register("nested_agg", "lineitem", lambda e: rounded(_nested(e).aggregate("order_docs", {"aggs": {"in_lines": {"nested": {"path": "lines"}, "aggs": {"flag": {"terms": {"field": "lines.l_returnflag"}, "aggs": {"avg_qty": {"avg": {"field": "lines.l_quantity"}}}}}}}})).drop("in_lines").withColumnRenamed("flag", "l_returnflag"), "SELECT l_returnflag, count(*) AS doc_count, round(avg(l_quantity), 4) AS avg_qty FROM lineitem GROUP BY 1")
register("reverse_nested", "lineitem", lambda e: _nested(e).aggregate("order_docs", {"aggs": {"in_lines": {"nested": {"path": "lines"}, "aggs": {"flag": {"terms": {"field": "lines.l_returnflag"}, "aggs": {"orders": {"reverse_nested": {}, "aggs": {"last": {"max": {"field": "l_orderkey"}}}}}}}}}}).drop("in_lines", "orders"), "SELECT l_returnflag AS flag, count(DISTINCT l_orderkey) AS doc_count, max(l_orderkey) AS last FROM lineitem GROUP BY 1")
register("inner_hits_top1", "lineitem", lambda e: _nested(e).search("order_docs", {"query": {"nested": {"path": "lines", "query": {"match_all": {}}, "inner_hits": {"size": 1, "sort": [{"lines.l_extendedprice": "desc"}]}}}, "sort": ["l_orderkey"], "size": None}).select("l_orderkey", F.col("inner_hits_lines")[0]["l_extendedprice"].alias("top_price")), "SELECT l_orderkey, max(l_extendedprice) AS top_price FROM lineitem GROUP BY 1")
register("inner_hits_filtered", "lineitem", lambda e: _nested(e).search("order_docs", {"query": {"nested": {**_NQ["nested"], "inner_hits": {"name": "best", "size": 2, "sort": [{"lines.l_extendedprice": "desc"}]}}}, "sort": ["l_orderkey"], "size": None}).select("l_orderkey", F.explode("inner_hits_best").alias("h")).select("l_orderkey", F.col("h.l_extendedprice").alias("price")), "SELECT l_orderkey, l_extendedprice AS price FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) <= 2")
register("inner_hits_child", "orders lineitem", lambda e: e.search("orders", {"query": {"has_child": {"index": "lineitem", "parent_field": "l_orderkey", "id_field": "o_orderkey", "query": {"term": {"l_returnflag": "R"}}, "inner_hits": {"size": 2, "from": 1, "sort": [{"l_extendedprice": "desc"}, {"l_linenumber": "asc"}]}}}, "sort": ["o_orderkey"], "size": None}).select("o_orderkey", F.explode("inner_hits_lineitem").alias("h")).select("o_orderkey", F.col("h.l_linenumber").alias("line"), F.col("h.l_extendedprice").alias("price")), "SELECT l_orderkey AS o_orderkey, l_linenumber AS line, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) BETWEEN 2 AND 3")
_RULES = {"big": {"range": {"value": {"gt": 50}}}, "clicks": {"term": {"event_type": "click"}}, "costly": {"bool": {"must": [{"term": {"event_type": "purchase"}}, {"range": {"value": {"gte": 20}}}]}}}
register("percolate", "events", lambda e: percolate.percolate(e.index("events").df, _RULES).select("rule", "event_id"), "SELECT 'big' AS rule, event_id FROM events WHERE value > 50 UNION ALL SELECT 'clicks', event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'costly', event_id FROM events WHERE event_type = 'purchase' AND value >= 20")

# ---- metrics ----------------------------------------------------------------------------------------------------------


def metric(name, index, spec, sql, query=None):
    register(name, index, table(index, {"query": query, "aggs": spec} if query else {"aggs": spec}), sql)


P = {"field": "o_totalprice"}
metric("stats", "orders", {"p": {"stats": P}}, "SELECT count(o_totalprice) AS p_count, round(avg(o_totalprice), 4) AS p_avg, round(sum(o_totalprice), 4) AS p_sum, round(min(o_totalprice), 4) AS p_min, round(max(o_totalprice), 4) AS p_max FROM orders")
metric("extended_stats", "lineitem", {"q": {"extended_stats": {"field": "l_quantity"}}}, "SELECT count(l_quantity) AS q_count, round(avg(l_quantity), 4) AS q_avg, round(sum(l_quantity), 4) AS q_sum, min(l_quantity) AS q_min, max(l_quantity) AS q_max, round(sum(l_quantity * l_quantity), 4) AS q_sum_of_squares, round(var_pop(l_quantity), 4) AS q_variance, round(var_samp(l_quantity), 4) AS q_variance_sampling, round(stddev_pop(l_quantity), 4) AS q_std_deviation, round(stddev_samp(l_quantity), 4) AS q_std_deviation_sampling, round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 4) AS q_upper, round(avg(l_quantity) - 2 * stddev_pop(l_quantity), 4) AS q_lower FROM lineitem")
metric("value_count", "orders", {"n": {"value_count": P}}, "SELECT count(o_totalprice) AS n FROM orders")
metric("percentiles", "orders", {"p": {"percentiles": {**P, "percents": [25, 50, 95]}}}, "SELECT round(quantile_cont(o_totalprice, 0.25), 4) AS p_25, round(quantile_cont(o_totalprice, 0.5), 4) AS p_50, round(quantile_cont(o_totalprice, 0.95), 4) AS p_95 FROM orders")
metric("percentile_ranks", "orders", {"p": {"percentile_ranks": {**P, "values": [1000, 50000]}}}, "SELECT round(avg((o_totalprice <= 1000)::INT) * 100, 4) AS p_1000, round(avg((o_totalprice <= 50000)::INT) * 100, 4) AS p_50000 FROM orders")
metric("mad", "orders", {"m": {"median_absolute_deviation": P}}, "SELECT round(mad(o_totalprice), 4) AS m FROM orders")
metric("cardinality_exact", "orders", {"n": {"cardinality": {"field": "o_custkey"}}}, "SELECT count(DISTINCT o_custkey) AS n FROM orders")
metric("cardinality_approx", "orders", {"n": {"cardinality": {"field": "o_custkey", "exact": False}}}, None)
metric("weighted_avg", "lineitem", {"w": {"weighted_avg": {"value": {"field": "l_extendedprice"}, "weight": {"field": "l_quantity"}}}}, "SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS w FROM lineitem")
metric("matrix_stats", "lineitem", {"m": {"matrix_stats": {"fields": ["l_quantity", "l_discount"]}}}, "SELECT count(*) AS m_count, round(avg(l_quantity), 4) AS m_l_quantity_mean, round(var_samp(l_quantity), 4) AS m_l_quantity_variance, round(avg(l_discount), 4) AS m_l_discount_mean, round(var_samp(l_discount), 4) AS m_l_discount_variance, round(covar_samp(l_quantity, l_discount), 4) AS m_l_quantity_l_discount_covariance, round(corr(l_quantity, l_discount), 4) AS m_l_quantity_l_discount_correlation, " + ", ".join(f"round(sum(pow({c} - a{c}, 3)) / count(*) / pow(var_pop({c}), 1.5), 4) AS m_{c}_skewness, round(sum(pow({c} - a{c}, 4)) / count(*) / pow(var_pop({c}), 2), 4) AS m_{c}_kurtosis" for c in ("l_quantity", "l_discount")) + " FROM lineitem, (SELECT avg(l_quantity) AS al_quantity, avg(l_discount) AS al_discount FROM lineitem)")
register("top_hits", "orders", lambda e: e.aggregate("orders", {"aggs": {"o_orderstatus": {"terms": {"field": "o_orderstatus"}, "aggs": {"best": {"top_hits": {"size": 2, "sort": [{"o_totalprice": "desc"}, {"o_orderkey": "asc"}], "_source": ["o_orderkey"]}}}}}}).select("o_orderstatus", F.explode("best").alias("h")).select("o_orderstatus", "h.o_orderkey"), "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
_LOOP = "double t = 0; for (x in {}) {{ t += x }} return t"
register("scripted_metric", "lineitem", lambda e: rounded(e.aggregate("lineitem", {"aggs": {"profit": {"scripted_metric": {"init_script": "state.sales = []", "map_script": "state.sales.add(doc['l_returnflag'].value == 'R' ? -1 * doc['l_extendedprice'].value : doc['l_extendedprice'].value)", "combine_script": _LOOP.format("state.sales"), "reduce_script": _LOOP.format("states")}}}}), 2), "SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS profit FROM lineitem")

# ---- buckets ----------------------------------------------------------------------------------------------------------

metric("terms_agg", "orders", {"o_orderpriority": {"terms": {"field": "o_orderpriority"}, "aggs": {"avg_price": {"avg": P}}}}, "SELECT o_orderpriority, count(*) AS doc_count, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
metric("terms_order_metric", "orders", {"o_custkey": {"terms": {"field": "o_custkey", "size": 7, "order": {"total": "desc"}}, "aggs": {"total": {"sum": P}}}}, "SELECT o_custkey, count(*) AS doc_count, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 7")
metric("terms_include_exclude", "orders", {"k": {"terms": {"field": "o_orderpriority", "include": "[1-4].*", "exclude": ["2-HIGH"]}}}, "SELECT o_orderpriority AS k, count(*) AS doc_count FROM orders WHERE regexp_full_match(o_orderpriority, '[1-4].*') AND o_orderpriority <> '2-HIGH' GROUP BY 1")
metric("terms_missing", "events", {"k": {"terms": {"field": "event_type", "missing": "none"}}}, "SELECT coalesce(event_type, 'none') AS k, count(*) AS doc_count FROM events GROUP BY 1")
metric("terms_partition", "orders", {"k": {"terms": {"field": "o_custkey", "include": {"partition": 0, "num_partitions": 4}, "size": None}}}, None)
metric("terms_text", "documents", {"word": {"terms": {"field": "text", "size": 20}}}, f"SELECT word, count(*) AS doc_count FROM (SELECT unnest(list_distinct(list_filter({TOK}, lambda x: x <> ''))) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
metric("multi_terms", "lineitem", {"k": {"multi_terms": {"terms": [{"field": "l_returnflag"}, {"field": "l_linestatus"}]}, "aggs": {"q": {"sum": {"field": "l_quantity"}}}}}, "SELECT l_returnflag AS k_0, l_linestatus AS k_1, count(*) AS doc_count, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY 1, 2")
metric("nested_terms", "lineitem", {"l_returnflag": {"terms": {"field": "l_returnflag"}, "aggs": {"l_linestatus": {"terms": {"field": "l_linestatus"}, "aggs": {"price": {"avg": {"field": "l_extendedprice"}}}}}}}, "SELECT l_returnflag, l_linestatus, count(*) AS doc_count, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2")
metric("rare_terms", "orders", {"k": {"rare_terms": {"field": "o_custkey", "max_doc_count": 5}}}, "SELECT o_custkey AS k, count(*) AS doc_count FROM orders GROUP BY 1 HAVING count(*) <= 5")
metric("histogram", "orders", {"bucket": {"histogram": {"field": "o_totalprice", "interval": 25000, "offset": 100}}}, "SELECT floor((o_totalprice - 100) / 25000) * 25000 + 100 AS bucket, count(*) AS doc_count FROM orders GROUP BY 1")
register("histogram_bounds", "lineitem", lambda e: aggs.filled(e.aggregate("lineitem", {"query": {"range": {"l_quantity": {"gte": 20, "lte": 30}}}, "aggs": {"b": {"histogram": {"field": "l_quantity", "interval": 5}}}}).withColumn("b", F.col("b").cast("long")), "b", F.lit(5).cast("long"), None, (0, 50)).select("b", "doc_count"), "SELECT r.b, count(l_quantity) AS doc_count FROM (SELECT unnest(range(0, 51, 5)) AS b) r LEFT JOIN lineitem ON l_quantity BETWEEN 20 AND 30 AND floor(l_quantity / 5) * 5 = r.b GROUP BY 1")
metric("date_hist_fixed", "events", {"bucket": {"date_histogram": {"field": "ts", "fixed_interval": "12h"}, "aggs": {"v": {"avg": {"field": "value"}}}}}, "SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS doc_count, round(avg(value), 4) AS v FROM events GROUP BY 1")
metric("date_hist_month", "orders", {"bucket": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month"}}}, "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*) AS doc_count FROM orders GROUP BY 1")
metric("date_hist_week", "orders", {"bucket": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "week"}}}, "WITH t AS (SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS bucket FROM orders), f AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 7 DAY)) AS bucket FROM t) SELECT f.bucket, count(t.bucket) AS doc_count FROM f LEFT JOIN t USING (bucket) GROUP BY 1")
metric("date_hist_offset", "events", {"bucket": {"date_histogram": {"field": "ts", "calendar_interval": "day", "offset": "+6h"}}}, "SELECT date_trunc('day', ts - INTERVAL 6 HOUR)::TIMESTAMP + INTERVAL 6 HOUR AS bucket, count(*) AS doc_count FROM events GROUP BY 1")
metric("date_hist_zone", "events", {"bucket": {"date_histogram": {"field": "ts", "calendar_interval": "day", "time_zone": "Asia/Tokyo"}}}, "SELECT date_trunc('day', ts + INTERVAL 9 HOUR)::TIMESTAMP - INTERVAL 9 HOUR AS bucket, count(*) AS doc_count FROM events GROUP BY 1")
metric("auto_date_histogram", "events", {"bucket": {"auto_date_histogram": {"field": "ts", "buckets": 40}}}, "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS doc_count FROM events GROUP BY 1")
metric("range_agg", "orders", {"k": {"range": {"field": "o_totalprice", "ranges": [{"to": 50000, "key": "low"}, {"from": 20000, "to": 150000, "key": "mid"}, {"from": 100000, "key": "high"}]}}}, " UNION ALL ".join(f"SELECT '{k}' AS k, count(*) AS doc_count FROM orders WHERE {w}" for k, w in (("low", "o_totalprice < 50000"), ("mid", "o_totalprice >= 20000 AND o_totalprice < 150000"), ("high", "o_totalprice >= 100000"))))
metric("date_range_agg", "orders", {"k": {"date_range": {"field": "o_orderdate", "ranges": [{"to": "1997-01-01", "key": "old"}, {"from": "1997-01-01", "key": "new"}]}}}, "SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'old' ELSE 'new' END AS k, count(*) AS doc_count FROM orders GROUP BY 1")
metric("filters_other", "orders", {"k": {"filters": {"other_bucket_key": "rest", "filters": {"done": {"term": {"o_orderstatus": "F"}}, "big": {"range": {"o_totalprice": {"gt": 100000}}}}}}}, "SELECT 'done' AS k, count(*) AS doc_count FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'big', count(*) FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'rest', count(*) FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)")
metric("filter_agg", "orders", {"k": {"filter": {"term": {"o_orderstatus": "F"}}, "aggs": {"p": {"avg": P}}}}, "SELECT 'filter' AS k, count(*) AS doc_count, round(avg(o_totalprice), 4) AS p FROM orders WHERE o_orderstatus = 'F'")
metric("adjacency_matrix", "orders", {"k": {"adjacency_matrix": {"filters": {"A": {"term": {"o_orderstatus": "F"}}, "B": {"range": {"o_totalprice": {"gt": 50000}}}}}}}, "SELECT 'A' AS k, count(*) AS doc_count FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'B', count(*) FROM orders WHERE o_totalprice > 50000 UNION ALL SELECT 'A&B', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000")
metric("global_agg", "orders", {"k": {"global": {}, "aggs": {"p": {"avg": P}}}}, "SELECT 'global' AS k, count(*) AS doc_count, round(avg(o_totalprice), 4) AS p FROM orders", {"term": {"o_orderstatus": "F"}})
metric("composite_after", "orders", {"c": {"composite": {"size": 8, "after": {"s": "F", "p": "2-HIGH"}, "sources": [{"s": {"terms": {"field": "o_orderstatus"}}}, {"p": {"terms": {"field": "o_orderpriority"}}}]}}}, "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS doc_count FROM orders WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND o_orderpriority > '2-HIGH') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 8")
register("significant_terms", "orders", lambda e: rounded(aggs.significant(e, "orders", {"range": {"o_totalprice": {"gt": 100000}}}, "o_orderpriority")), "SELECT key, doc_count, bg_count, round((doc_count / f - bg_count / n) * ((doc_count / f) / (bg_count / n)), 4) AS score FROM (SELECT o_orderpriority AS key, count(*) FILTER (o_totalprice > 100000) AS doc_count, count(*) AS bg_count FROM orders GROUP BY 1), (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS f FROM orders) WHERE doc_count >= 3 AND doc_count / f > bg_count / n ORDER BY score DESC, key LIMIT 10")
metric("sampler", "orders", {"s": {"sampler": {"shard_size": 50}, "aggs": {"p": {"avg": P}}}}, "SELECT 'sample' AS s, count(*) AS doc_count, round(avg(o_totalprice), 4) AS p FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)")
metric("diversified_sampler", "orders", {"s": {"diversified_sampler": {"field": "o_custkey", "shard_size": 500}, "aggs": {"p": {"avg": P}}}}, "SELECT 'sample' AS s, count(*) AS doc_count, round(avg(o_totalprice), 4) AS p FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_orderkey LIMIT 500)")

# ---- pipelines over buckets -------------------------------------------------------------------------------------------

_MONTHS = {"aggs": {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month"}, "aggs": {"s": {"sum": P}}}}}
_M = "WITH t AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS doc_count, sum(o_totalprice) AS s FROM orders GROUP BY 1) "


def piped(name, fn, sql, digits=2):
    register(name, "orders", lambda e: rounded(fn(e.aggregate("orders", _MONTHS)), digits), _M + sql if sql else None)


piped("cumulative_sum", lambda t: pipeline.cumulative_sum(t, "m", "s", "x").select("m", "x"), "SELECT m, round(sum(s) OVER (ORDER BY m), 2) AS x FROM t")
piped("derivative", lambda t: pipeline.derivative(t, "m", "s", "x").select("m", "x"), "SELECT m, round(s - lag(s) OVER (ORDER BY m), 2) AS x FROM t")
piped("serial_diff", lambda t: pipeline.serial_diff(t, "m", "s", "x", 12).select("m", "x"), "SELECT m, round(s - lag(s, 12) OVER (ORDER BY m), 2) AS x FROM t")
piped("moving_avg", lambda t: pipeline.moving_avg(t, "m", "s", "x", 5).select("m", "x"), "SELECT m, round(avg(s) OVER (ORDER BY m ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 2) AS x FROM t")
piped("moving_fn_sum", lambda t: pipeline.moving_fn(t, "m", "s", "x", "sum", 3, 1).select("m", "x"), "SELECT m, round(coalesce(sum(s) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0), 2) AS x FROM t")
piped("moving_fn_linear", lambda t: pipeline.moving_fn(t, "m", "s", "x", "linearWeightedAvg", 3).select("m", "x"), "SELECT m, round(CASE WHEN c IS NOT NULL THEN (a * 3 + b * 2 + c) / 6 WHEN b IS NOT NULL THEN (a * 2 + b) / 3 ELSE a END, 2) AS x FROM (SELECT m, lag(s) OVER w AS a, lag(s, 2) OVER w AS b, lag(s, 3) OVER w AS c FROM t WINDOW w AS (ORDER BY m))")
piped("moving_fn_ewma", lambda t: pipeline.moving_fn(t, "m", "s", "x", "ewma", 2, alpha=0.3).select("m", "x"), "SELECT m, round(CASE WHEN b IS NOT NULL THEN a * 0.3::DOUBLE + b * (1 - 0.3)::DOUBLE ELSE a END, 4) AS x FROM (SELECT m, lag(s) OVER w AS a, lag(s, 2) OVER w AS b FROM t WINDOW w AS (ORDER BY m))", 4)
piped("moving_fn_holt", lambda t: pipeline.moving_fn(t, "m", "s", "x", "holt", 6).select("m", "x"), None)
piped("moving_fn_holt_winters", lambda t: pipeline.moving_fn(t, "m", "s", "x", "holtWinters", 24, period=6).select("m", "x"), None)
piped("bucket_script", lambda t: pipeline.bucket_script(t, "x", {"a": "s", "n": "doc_count"}, "params.a / params.n").select("m", "x"), "SELECT m, round(s / doc_count, 2) AS x FROM t")
piped("bucket_selector", lambda t: pipeline.bucket_selector(t, {"n": "doc_count"}, "params.n > 18").select("m", "doc_count"), "SELECT m, doc_count FROM t WHERE doc_count > 18")
piped("bucket_sort", lambda t: pipeline.bucket_sort(t, [("s", "desc")], 5, 2).select("m", "s"), "SELECT m, round(s, 2) AS s FROM t ORDER BY t.s DESC LIMIT 5 OFFSET 2")
for _k, _f in (("avg", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max")):
    piped(f"{_k}_bucket", (lambda k: lambda t: pipeline.sibling(t, f"{k}_bucket", "s", "x"))(_k), f"SELECT round({_f}(s), 2) AS x FROM t")
piped("stats_bucket", lambda t: pipeline.sibling(t, "stats_bucket", "s", "x"), "SELECT count(s) AS x_count, round(min(s), 2) AS x_min, round(max(s), 2) AS x_max, round(avg(s), 2) AS x_avg, round(sum(s), 2) AS x_sum FROM t")
piped("extended_stats_bucket", lambda t: pipeline.sibling(t, "extended_stats_bucket", "doc_count", "x"), "SELECT count(s) AS x_count, min(doc_count)::DOUBLE AS x_min, max(doc_count)::DOUBLE AS x_max, round(avg(doc_count), 4) AS x_avg, sum(doc_count)::DOUBLE AS x_sum, sum(doc_count * doc_count)::DOUBLE AS x_sum_of_squares, round(var_pop(doc_count), 4) AS x_variance, round(stddev_pop(doc_count), 4) AS x_std_deviation, round(avg(doc_count) + 2 * stddev_pop(doc_count), 4) AS x_upper, round(avg(doc_count) - 2 * stddev_pop(doc_count), 4) AS x_lower FROM t", 4)
piped("percentiles_bucket", lambda t: pipeline.sibling(t, "percentiles_bucket", "s", "x", percents=(25, 50, 75)), "SELECT " + ", ".join(f"round(list_sort(list(s))[floor({p / 100} * (count(*) - 1) + 0.5)::INT + 1], 2) AS x_{p}" for p in (25, 50, 75)) + " FROM t")

# ---- SQL and PPL ------------------------------------------------------------------------------------------------------


def sql(name, tables, text, oracle=None):
    register(name, tables, lambda e: e.sql(text), oracle or text)


sql("sql_group_having", "orders", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM orders WHERE o_totalprice > 5000 GROUP BY o_orderstatus HAVING count(*) > 10")
sql("sql_default_limit", "region", "SELECT r_regionkey, r_name FROM region")
sql("sql_limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
sql("sql_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("sql_case_whole", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS size FROM orders ORDER BY o_orderkey LIMIT ALL", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS size FROM orders ORDER BY o_orderkey")
sql("sql_between_in_like_whole", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%-H%' ORDER BY o_orderkey LIMIT ALL", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%-H%' ORDER BY o_orderkey")
sql("sql_functions_whole", "customer", "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, substring(c_name, 1, 4) AS s, concat(c_name, '!') AS c, replace(c_name, '#', '-') AS r, abs(c_acctbal) AS a, coalesce(c_mktsegment, '-') AS m FROM customer ORDER BY c_custkey LIMIT ALL", "SELECT c_custkey, upper(c_name) AS u, length(c_name)::INT AS n, substring(c_name, 1, 4) AS s, concat(c_name, '!') AS c, replace(c_name, '#', '-') AS r, abs(c_acctbal) AS a, coalesce(c_mktsegment, '-') AS m FROM customer ORDER BY c_custkey")
sql("sql_date_parts", "orders", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2", "SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, count(*) AS n FROM orders GROUP BY 1, 2")
sql("sql_aggregates", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, round(var_pop(l_quantity), 4) AS v, round(stddev_samp(l_quantity), 4) AS s FROM lineitem GROUP BY l_returnflag")
sql("sql_full_text_whole", "part", "SELECT p_partkey FROM part WHERE match(p_name, 'red') AND p_size > 5 LIMIT ALL", "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red') AND p_size > 5")
sql("ext_inner_join", "orders customer", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql("ext_left_join", "customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
sql("ext_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("ext_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("ext_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
sql("ext_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("ext_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("ext_row_number_whole", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r = 1 LIMIT ALL", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r = 1")


def ppl(name, table_, text, oracle):
    register(name, table_, lambda e: rounded(e.ppl(text)), oracle)


ppl("ppl_stats", "orders", "source=orders | where o_totalprice > 5000 | stats count() as n, avg(o_totalprice) as a by o_orderstatus", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS a, o_orderstatus FROM orders WHERE o_totalprice > 5000 GROUP BY o_orderstatus")
ppl("ppl_stats_where", "orders", "source=orders | stats count() as n by o_custkey | where n > 12 | sort -n, +o_custkey | head 20", "SELECT n, o_custkey FROM (SELECT count(*) AS n, o_custkey FROM orders GROUP BY 2) WHERE n > 12 ORDER BY n DESC, o_custkey LIMIT 20")
ppl("ppl_eval", "lineitem", "source=lineitem | eval net = l_extendedprice * (1 - l_discount) | stats sum(net) as s by l_returnflag", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS s, l_returnflag FROM lineitem GROUP BY 2")
ppl("ppl_top", "orders", "source=orders | top 3 o_orderpriority", "SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3")
ppl("ppl_rare", "orders", "source=orders | rare 2 o_orderstatus", "SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*), 1 LIMIT 2")
ppl("ppl_dedup", "lineitem", "source=lineitem | dedup l_returnflag, l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
ppl("ppl_fields_rename_whole", "orders", "source=orders o_orderstatus = 'P' | fields o_orderkey, o_totalprice | rename o_totalprice as price | sort o_orderkey", "SELECT o_orderkey, round(o_totalprice, 4) AS price FROM orders WHERE o_orderstatus = 'P' ORDER BY 1")

# ---- vectors ----------------------------------------------------------------------------------------------------------

_V = [0.1 * ((i % 7) - 3) for i in range(64)]
_VS = f"[{', '.join(f'{x:.17g}' for x in _V)}]::DOUBLE[]"


def knn(name, space, d):
    register(name, "embeddings", lambda e: rounded(e.index("embeddings").df.select("vec_id", vectors.distance(F.col("embedding"), F.array(*map(F.lit, _V)), space).alias("d")).orderBy("d", "vec_id").limit(10), 3), f"SELECT vec_id, round({d}, 3) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e, {_VS} AS q FROM embeddings) ORDER BY {d}, vec_id LIMIT 10")


knn("knn_l2", "l2", "pow(list_distance(e, q), 2)")
knn("knn_l1", "l1", "list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2])))")
knn("knn_linf", "linf", "list_max(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2])))")
knn("knn_cosine", "cosine", "1 - list_cosine_similarity(e, q)")
knn("knn_ip", "innerproduct", "-list_inner_product(e, q)")
register("knn_filtered", "embeddings", lambda e: e.filtered("embeddings", {"knn": {"embedding": {"vector": _V, "k": 5, "filter": {"range": {"label": {"lt": 5}}}}}}).select("vec_id"), f"SELECT vec_id FROM embeddings WHERE label < 5 ORDER BY pow(list_distance(embedding::DOUBLE[], {_VS}), 2), vec_id LIMIT 5")
register("knn_radius", "embeddings", lambda e: e.filtered("embeddings", {"knn": {"embedding": {"vector": _V, "max_distance": 60}}}).select("vec_id"), f"SELECT vec_id FROM embeddings WHERE pow(list_distance(embedding::DOUBLE[], {_VS}), 2) <= 60")
for _n in ("min_max", "l2", "z_score", "rrf"):
    register(f"hybrid_{_n}", "orders", (lambda n: lambda e: rounded(hybrid.hybrid(e, "orders", [{"rank_feature": {"field": "o_totalprice", "saturation": {"pivot": 1000}}}, {"distance_feature": {"field": "o_totalprice", "origin": 100000, "pivot": 500}}], n, "rrf" if n == "rrf" else "arithmetic_mean")))(_n))


def _rank_eval(e):
    ranked = e.index("orders").df.select(F.col("o_orderstatus").alias("query"), F.col("o_orderkey").alias("doc"), F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    ratings = e.index("orders").df.select(F.col("o_orderstatus").alias("query"), F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 3).cast("int").alias("rating"))
    return rounded(hybrid.rank_metrics(ranked, ratings))


register("rank_eval", "orders", _rank_eval, "WITH r AS (SELECT o_orderstatus AS query, o_orderkey % 3 AS rating, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), a AS (SELECT query, count(*) FILTER (rating >= 1) AS n FROM r GROUP BY 1) SELECT r.query, round(count(*) FILTER (rating >= 1) / count(*), 4) AS precision, round(count(*) FILTER (rating >= 1) / any_value(a.n), 4) AS recall, round(coalesce(1 / min(rank) FILTER (rating >= 1), 0), 4) AS mrr, round(sum((pow(2, rating) - 1) / log2(rank + 1)), 4) AS dcg FROM r JOIN a ON r.query = a.query WHERE rank <= 10 GROUP BY 1")

# ---- ingest -----------------------------------------------------------------------------------------------------------


def ing(name, index, processors, cols, sql_):
    register(name, index, lambda e: ingest.apply(e.index(index).df, processors).selectExpr(*cols), sql_)


ing("ingest_grok", "pages", [{"grok": {"field": "url", "patterns": ["%{URIPROTO:proto}://%{URIHOST:host}%{URIPATH:path}"]}}], ("page_id", "proto", "host"), "SELECT page_id, nullif(regexp_extract(url, '([A-Za-z][A-Za-z0-9+.-]*)://([A-Za-z0-9.-]+(?::[0-9]+)?)((?:/[^\\s?#]*)+)', 1), '') AS proto, nullif(regexp_extract(url, '([A-Za-z][A-Za-z0-9+.-]*)://([A-Za-z0-9.-]+(?::[0-9]+)?)((?:/[^\\s?#]*)+)', 2), '') AS host FROM pages")
ing("ingest_dissect", "pages", [{"dissect": {"field": "url", "pattern": "%{proto}://%{rest}"}}], ("page_id", "proto", "rest"), "SELECT page_id, string_split(url, '://')[1] AS proto, substr(url, strpos(url, '://') + 3) AS rest FROM pages")
ing("ingest_gsub_case", "customer", [{"gsub": {"field": "c_name", "pattern": "[0-9]+", "replacement": "N"}}, {"uppercase": {"field": "c_name"}}, {"trim": {"field": "c_name"}}], ("c_custkey", "c_name"), "SELECT c_custkey, trim(upper(regexp_replace(c_name, '[0-9]+', 'N', 'g'))) AS c_name FROM customer")
ing("ingest_json", "events", [{"json": {"field": "props", "target_field": "p", "schema": "k int"}}], ("event_id", "p.k"), "SELECT event_id, (props->>'k')::INT AS k FROM events")
ing("ingest_convert", "customer", [{"convert": {"field": "c_acctbal", "type": "long", "target_field": "whole"}}], ("c_custkey", "whole"), "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS whole FROM customer")
register("ingest_split_join_sort", "part", lambda e: ingest.apply(e.index("part").df, [{"split": {"field": "p_name", "separator": " "}}, {"sort": {"field": "p_name"}}, {"join": {"field": "p_name", "separator": "-"}}]).select("p_partkey", "p_name"), "SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), '-') AS p_name FROM part")
ing("ingest_fingerprint", "region", [{"fingerprint": {"fields": ["r_name"], "hash_method": "MD5@2.16.0"}}], ("r_regionkey", "fingerprint"), "SELECT r_regionkey, md5('|r_name|' || r_name || '|') AS fingerprint FROM region")
ing("ingest_html_strip", "pages", [{"html_strip": {"field": "html"}}], ("page_id", "html"), None)
ing("ingest_text_chunking", "documents", [{"text_chunking": {"field": "text", "target_field": "chunks", "token_limit": 100}}], ("doc_id", "size(chunks) AS n"), "SELECT doc_id, ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / 100)::INT AS n FROM documents")
ing("ingest_drop_if", "orders", [{"drop": {"if": "ctx.o_orderstatus == 'F'"}}], ("o_orderkey",), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
ing("ingest_set_script", "orders", [{"set": {"field": "kind", "value": "order"}}, {"script": {"source": "ctx.half = ctx.o_totalprice / 2"}}, {"remove": {"field": "o_orderdate"}}], ("o_orderkey", "kind", "round(half, 4) AS half"), "SELECT o_orderkey, 'order' AS kind, round(o_totalprice / 2, 4) AS half FROM orders")

# ---- jobs and streams -------------------------------------------------------------------------------------------------

def _groups() -> tuple[dict, dict]:
    keys = {"day": F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"), "event_type": F.col("event_type")}
    return keys, {"total": ("sum", "value"), "n": ("value_count", "value")}


_TSQL = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY 1, 2"


def _continuous(e):
    """Two batches, each followed by the recomputation of the groups that it touches."""
    df, (keys, metrics) = e.index("events").df, _groups()
    first, second = df.filter("event_id % 3 <> 0"), df.filter("event_id % 3 = 0")
    return rounded(jobs.continuous(jobs.continuous(None, first, first, keys, metrics), df, second, keys, metrics))


register("transform_batch", "events", lambda e: rounded(jobs.transform(e.index("events").df, *_groups())), _TSQL)
register("transform_continuous", "events", _continuous, _TSQL)
register("rollup_build", "events", lambda e: rounded(jobs.rollup(e.index("events").df, "ts", "hour", ["event_type"], "value")), "SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type, round(sum(value), 4) AS sum, count(value) AS count, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events GROUP BY 1, 2")
register("rollup_search", "events", lambda e: rounded(jobs.rollup_search(jobs.rollup(e.index("events").df, "ts", "hour", ["event_type"], "value"), ["event_type"])), "SELECT event_type, round(avg(value), 4) AS avg, round(sum(value), 4) AS sum, count(value) AS count, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events GROUP BY 1")
register("tumbling", "events", lambda e: rounded(jobs.tumbling(e.index("events").df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"])), "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
register("sliding", "events", lambda e: rounded(jobs.tumbling(e.index("events").df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", [], slide="1 hour")), "SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR]) AS start, value FROM events) GROUP BY 1")
register("session", "events", lambda e: jobs.sessions(e.index("events").df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "4 hours", "user_id"), "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")


# ---- aggregation trees --------------------------------------------------------------------------------------------------

_TREE = {"aggs": {"total": {"sum": P}, "s": {"terms": {"field": "o_orderstatus", "size": 2, "order": {"price": "desc"}}, "aggs": {"price": {"avg": P}, "p": {"terms": {"field": "o_orderpriority", "size": 3, "order": {"_key": "asc"}}, "aggs": {"c": {"cardinality": {"field": "o_custkey"}}, "y": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "year"}, "aggs": {"top": {"max": P}}}}}}}}}
register("tree_three_levels", "orders", lambda e: rounded(e.aggregate("orders", _TREE)), """
WITH s AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS price FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 2),
p AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(DISTINCT o_custkey) AS c, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r FROM orders GROUP BY 1, 2),
k AS (SELECT s, p, price, c FROM s JOIN p USING (s) WHERE r <= 3),
o AS (SELECT k.*, year(o_orderdate) AS y, o_totalprice FROM k JOIN orders ON o_orderstatus = s AND o_orderpriority = p),
f AS (SELECT s, p, any_value(price) AS price, any_value(c) AS c, unnest(generate_series(min(y), max(y))) AS y FROM o GROUP BY 1, 2)
SELECT f.s, f.p, make_timestamp(f.y, 1, 1, 0, 0, 0) AS y, count(o_totalprice) AS doc_count, round(max(o_totalprice), 4) AS top, round(any_value(f.price), 4) AS price, any_value(f.c) AS c, (SELECT round(sum(o_totalprice), 4) FROM orders) AS total
FROM f LEFT JOIN o ON o.s = f.s AND o.p = f.p AND o.y = f.y GROUP BY f.s, f.p, f.y""")
_SIDE = {"aggs": {"all": {"avg": P}, "s": {"terms": {"field": "o_orderstatus"}, "aggs": {"best": {"max": P}}}, "p": {"terms": {"field": "o_orderpriority"}, "aggs": {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"least": {"min": P}}}, "low": {"min_bucket": {"buckets_path": "s>least"}}}}, "high": {"max_bucket": {"buckets_path": "s>best"}}}}
for _name, _path, _sql in (
    ("tree_siblings_metrics", "", "SELECT round(avg(o_totalprice), 4) AS \"all\" FROM orders"),
    ("tree_siblings_first", "s", "SELECT o_orderstatus AS s, count(*) AS doc_count, round(max(o_totalprice), 4) AS best FROM orders GROUP BY 1"),
    ("tree_siblings_inner", "p>s", "SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS doc_count, round(min(o_totalprice), 4) AS least FROM orders GROUP BY 1, 2"),
    ("tree_sibling_pipeline", "high", "SELECT round(max(o_totalprice), 4)::DOUBLE AS high FROM orders"),
    ("tree_sibling_pipeline_per_parent", "p>low", "SELECT o_orderpriority AS p, round(min(o_totalprice), 4)::DOUBLE AS low FROM orders GROUP BY 1"),
):
    register(_name, "orders", lambda e, _path=_path: rounded(e.aggregate_tables("orders", _SIDE)[_path]), _sql)
_GAP = {"query": {"range": {"o_totalprice": {"gt": 150000}}}, "aggs": {"d": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "day"}, "aggs": {"s": {"sum": P}, "up": {"derivative": {"buckets_path": "s"}}, "so_far": {"cumulative_sum": {"buckets_path": "_count"}}}}}}
register("tree_gaps_and_pipelines", "orders", lambda e: rounded(e.aggregate("orders", _GAP), 2), """
WITH t AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS d, o_totalprice FROM orders WHERE o_totalprice > 150000),
f AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM t),
g AS (SELECT f.d, count(o_totalprice) AS doc_count, coalesce(sum(o_totalprice), 0) AS s FROM f LEFT JOIN t USING (d) GROUP BY 1)
SELECT d, doc_count, round(s, 2) AS s, round(s - lag(s) OVER (ORDER BY d), 2) AS up, sum(doc_count) OVER (ORDER BY d)::BIGINT AS so_far FROM g""")
metric("histogram_gaps", "orders", {"b": {"histogram": {"field": "o_totalprice", "interval": 500, "extended_bounds": {"min": -1000, "max": 2000}}}}, "WITH t AS (SELECT floor(o_totalprice / 500)::BIGINT AS i FROM orders), f AS (SELECT unnest(generate_series(least(min(i), -2), greatest(max(i), 4))) AS i FROM t) SELECT f.i * 500.0::DOUBLE AS b, count(t.i) AS doc_count FROM f LEFT JOIN t USING (i) GROUP BY f.i")
register("top_hits_string_desc", "orders", lambda e: e.aggregate("orders", {"aggs": {"o_orderstatus": {"terms": {"field": "o_orderstatus"}, "aggs": {"best": {"top_hits": {"size": 1, "_source": ["o_orderkey"], "sort": [{"o_orderpriority": "desc"}, "o_orderkey"]}}}}}}).select("o_orderstatus", F.col("best")[0]["o_orderkey"].alias("k")), "SELECT o_orderstatus, o_orderkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC, o_orderkey) AS r FROM orders) WHERE r = 1")

# ---- ingest conditions and failures --------------------------------------------------------------------------------------

_F = "ctx.o_orderstatus == 'F'"
ing("ingest_if_rename", "orders", [{"rename": {"field": "o_orderpriority", "target_field": "p", "if": _F}}], ("o_orderkey", "o_orderpriority", "p"), "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS p FROM orders")
ing("ingest_if_remove", "orders", [{"remove": {"field": "o_orderpriority", "if": _F}}], ("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders")
ing("ingest_if_script", "orders", [{"script": {"source": "ctx.o_totalprice = ctx.o_totalprice * 2", "if": _F}}], ("o_orderkey", "round(o_totalprice, 4) AS p"), "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END, 4) AS p FROM orders")
ing("ingest_if_copy", "orders", [{"copy": {"source_field": "o_orderstatus", "target_field": "o_orderpriority", "if": _F}}], ("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus ELSE o_orderpriority END AS o_orderpriority FROM orders")
ing("ingest_if_append", "part", [{"split": {"field": "p_name", "separator": " "}}, {"append": {"field": "p_name", "value": "large", "if": "ctx.p_size > 25"}}, {"join": {"field": "p_name", "separator": "-"}}], ("p_partkey", "p_name"), "SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_size > 25 THEN '-large' ELSE '' END AS p_name FROM part")
ing("ingest_if_grok", "pages", [{"grok": {"field": "url", "patterns": ["%{URIPROTO:url}://%{GREEDYDATA:rest}"], "if": "ctx.page_id > 50"}}], ("page_id", "url", "rest"), "SELECT page_id, CASE WHEN page_id > 50 THEN string_split(url, '://')[1] ELSE url END AS url, CASE WHEN page_id > 50 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages")
ing("ingest_if_csv", "part", [{"csv": {"field": "p_name", "target_fields": ["p_brand", "second"], "separator": " ", "if": "ctx.p_size > 25"}}], ("p_partkey", "p_brand", "second"), "SELECT p_partkey, CASE WHEN p_size > 25 THEN string_split(p_name, ' ')[1] ELSE p_brand END AS p_brand, CASE WHEN p_size > 25 THEN string_split(p_name, ' ')[2] END AS second FROM part")
ing("ingest_on_failure", "orders", [{"convert": {"field": "o_orderpriority", "type": "long", "target_field": "n", "on_failure": [{"set": {"field": "bad", "value": "yes", "if": _F}}]}}], ("o_orderkey", "n", "bad"), "SELECT o_orderkey, TRY_CAST(o_orderpriority AS BIGINT) AS n, CASE WHEN TRY_CAST(o_orderpriority AS BIGINT) IS NULL AND o_orderstatus = 'F' THEN 'yes' END AS bad FROM orders")
ing("ingest_ignore_failure", "orders", [{"fail": {"message": "never", "if": _F, "ignore_failure": True}}, {"dissect": {"field": "o_orderpriority", "pattern": "1-%{o_orderpriority}", "ignore_failure": True}}], ("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1-') THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS o_orderpriority FROM orders")

# ---- writes -------------------------------------------------------------------------------------------------------------


def _written(e):
    """Orders as an index; by the key's remainder they are left, updated twice, deleted, made anew or indexed over."""
    rows = e.index("orders").df
    doc = F.create_map(F.lit("status"), F.to_json(F.struct("o_orderstatus")), F.lit("n"), F.col("o_custkey").cast("string"))
    key = F.col("o_orderkey").cast("string")
    index = rows.filter("o_orderkey % 5 <> 3").select(key.alias("_id"), F.lit(1).cast("long").alias("_version"), doc.alias("doc"))
    put = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    none = F.lit(None).cast(writes.DOC)
    steps = [(1, "update", put("n", "7"), "1"), (2, "update", put("n", "7"), "1"), (3, "update", put("m", "8"), "1"), (4, "delete", none, "2"), (5, "create", put("n", "3"), "3"), (6, "create", put("n", "4"), "3"), (7, "index", put("n", "5"), "4")]
    actions = None
    for seq, op, d, rest in steps:
        part = rows.filter(f"o_orderkey % 5 = {rest}").select(F.lit(seq).cast("long").alias("_seq"), F.lit(op).alias("op"), key.alias("_id"), d.alias("doc"), none.alias("upsert"))
        actions = part if actions is None else actions.unionByName(part)
    return writes.bulk(index, actions).select(F.col("_id").cast("bigint").alias("k"), "_version", F.col("doc")["n"].alias("n"), F.col("doc")["m"].alias("m"))


register("write_bulk", "orders", _written, "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 1 THEN CASE WHEN o_custkey = 7 THEN 2 ELSE 3 END WHEN 4 THEN 2 ELSE 1 END::BIGINT AS _version, CASE o_orderkey % 5 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN '7' WHEN 3 THEN '3' ELSE '5' END AS n, CASE o_orderkey % 5 WHEN 1 THEN '8' END AS m FROM orders WHERE o_orderkey % 5 <> 2")
register("write_delete_by_query", "orders", lambda e: writes.delete_by_query(e.index("orders").df, F.col("o_orderstatus") == "F").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
register("write_update_by_query", "orders", lambda e: writes.update_by_query(e.index("orders").df, F.col("o_orderstatus") == "F", [{"script": {"source": "ctx.o_totalprice = ctx.o_totalprice + 1"}}, {"drop": {"if": "ctx.o_orderpriority == '1-URGENT'"}}]).select("o_orderkey", F.round("o_totalprice", 4).alias("p")), "SELECT o_orderkey, round(o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, 4) AS p FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
register("write_reindex", "orders", lambda e: writes.reindex(e.index("orders").df, F.col("o_totalprice") > 50000, [{"rename": {"field": "o_orderstatus", "target_field": "status"}}], ["o_orderkey", "o_orderstatus"]), "SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_totalprice > 50000")
