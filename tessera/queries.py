"""Named queries over the test tables, one or more for each operator, with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import driver_tables
from tessera.store import QuadStore

PREFIXES = """PREFIX v: <http://ex.org/v#> PREFIX g: <http://ex.org/g/> PREFIX n: <http://ex.org/nation/> PREFIX c: <http://ex.org/customer/>
PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
"""
X = "'http://ex.org/"
TYPE = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"



def _everything() -> str:
    """The number of triples of each predicate of all tables."""
    held = {"o_year": "o_orderdate", "toxic": "toxic", "labels": "doc_id", "item_text": "text", "conv": "conv_id", "said": "text", "next": "turn"}
    parts = [f"SELECT {TYPE} AS p, count(*) AS c FROM {t.name}" for t in driver_tables()]
    for t in driver_tables():
        parts += [f"SELECT {X}v#{c}', count({c}) FROM {t.name}" + (f" WHERE lang IN {t.langs[c][1]}" if c in t.langs else "") for c in t.columns]
        parts += [f"SELECT {X}v#{c}', count({held[c]}) FROM {t.name}" for c in t.extra]
    return f"SELECT p, sum(c)::BIGINT AS c FROM ({' UNION ALL '.join(parts)}) GROUP BY p"


#: name: (SPARQL, DuckDB)
QUERIES: dict[str, tuple[str, str]] = {
    # -- scans
    "flagship": (
        'SELECT ?nation (ROUND(SUM(?price)*100)/100 AS ?rev) (COUNT(*) AS ?n) WHERE { ?o v:o_custkey ?c ; v:o_totalprice ?price ; v:o_orderstatus "F" . ?c v:c_nationkey ?k . ?k v:n_name ?nation } GROUP BY ?nation ORDER BY ?nation',
        "SELECT n_name AS nation, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS rev, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name",
    ),
    "scan_p": ("SELECT ?s ?n WHERE { ?s v:c_name ?n }", f"SELECT {X}customer/' || c_custkey AS s, c_name AS n FROM customer"),
    "scan_all_counts": (
        "SELECT ?p (COUNT(*) AS ?c) FROM g:nation FROM g:region WHERE { ?s ?p ?o } GROUP BY ?p",
        f"SELECT * FROM (VALUES ({TYPE}, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)), ({X}v#n_nationkey', (SELECT count(n_nationkey) FROM nation)), ({X}v#n_name', (SELECT count(n_name) FROM nation)), ({X}v#n_regionkey', (SELECT count(n_regionkey) FROM nation)), ({X}v#r_regionkey', (SELECT count(r_regionkey) FROM region)), ({X}v#r_name', (SELECT count(r_name) FROM region))) t(p, c)",
    ),
    "scan_everything": ("SELECT ?p (COUNT(*) AS ?c) WHERE { ?s ?p ?o } GROUP BY ?p", _everything()),
    "seek_s": ("SELECT ?p ?o WHERE { n:3 ?p ?o }", f"SELECT {TYPE} AS p, {X}v#Nation' AS o UNION ALL SELECT unnest([{X}v#n_nationkey', {X}v#n_name', {X}v#n_regionkey']), unnest([n_nationkey::VARCHAR, n_name, {X}region/' || n_regionkey]) FROM nation WHERE n_nationkey = 3"),
    "seek_o": ("SELECT ?s WHERE { ?s v:c_nationkey n:7 }", f"SELECT {X}customer/' || c_custkey AS s FROM customer WHERE c_nationkey = 7"),
    "seek_so": ("SELECT ?n WHERE { c:5 v:c_nationkey ?k ; v:c_name ?n . ?k v:n_regionkey ?r }", "SELECT c_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5"),
    "kind_prune": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a v:Orders FILTER(isIRI(?o)) } GROUP BY ?p", f"SELECT {TYPE} AS p, count(*) AS n FROM orders UNION ALL SELECT {X}v#o_custkey', count(*) FROM orders UNION ALL SELECT {X}v#o_orderkey', 0 FROM orders WHERE false GROUP BY 1"),
    "datatype_prune": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s a v:Part ; ?p ?o FILTER(DATATYPE(?o) = xsd:int) } GROUP BY ?p", f"SELECT {X}v#p_size' AS p, count(p_size) AS n FROM part"),
    "repeated_variable": ("SELECT ?s WHERE { ?s v:labels ?x . ?x v:source ?g . ?x v:source ?g }", f"SELECT {X}labels/' || l.doc_id AS s FROM labels l JOIN documents d USING (doc_id)"),
    "ordered_scan": ('SELECT ?s ?n WHERE { ?s v:p_name ?n ; v:p_size ?z FILTER(?z < 5) } ORDER BY ?n ?s', f"SELECT {X}part/' || p_partkey AS s, p_name AS n FROM part WHERE p_size < 5"),
    "blank_subject": ("SELECT ?f (COUNT(?l) AS ?n) WHERE { ?l v:l_returnflag ?f FILTER(isBlank(?l)) } GROUP BY ?f", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1"),
    # -- graphs
    "graph_named": ("SELECT ?d ?n WHERE { GRAPH g:src1 { ?d v:n_chars ?n } }", f"SELECT {X}documents/' || doc_id AS d, n_chars AS n FROM documents WHERE source = 'src1'"),
    "graph_var": ("SELECT ?g (COUNT(?d) AS ?n) WHERE { GRAPH ?g { ?d a v:Documents } } GROUP BY ?g", f"SELECT {X}g/' || source AS g, count(*) AS n FROM documents GROUP BY 1"),
    "from_multi": ("SELECT ?d FROM g:src1 FROM g:src2 WHERE { ?d v:n_chars ?n FILTER(?n > 1000) }", f"SELECT {X}documents/' || doc_id AS d FROM documents WHERE source IN ('src1', 'src2') AND n_chars > 1000"),
    "from_named": ("SELECT ?g ?d FROM NAMED g:src3 FROM NAMED g:src4 WHERE { GRAPH ?g { ?d v:n_chars ?n FILTER(?n > 1000) } }", f"SELECT {X}g/' || source AS g, {X}documents/' || doc_id AS d FROM documents WHERE source IN ('src3', 'src4') AND n_chars > 1000"),
    "union_graph_dedupe": ("SELECT ?c ?n FROM g:customer FROM g:seventh WHERE { ?c v:c_name ?n ; v:c_nationkey n:7 }", f"SELECT DISTINCT {X}customer/' || c_custkey AS c, c_name AS n FROM customer WHERE c_nationkey = 7"),
    "graph_multi": ("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?c v:c_name ?x } } GROUP BY ?g", f"SELECT {X}g/customer' AS g, count(*) AS n FROM customer UNION ALL SELECT {X}g/seventh', count(*) FROM customer WHERE c_nationkey = 7"),
    # -- joins
    "join_fk": ("SELECT ?o ?n WHERE { ?o v:o_custkey ?c ; v:o_totalprice ?t . ?c v:c_name ?n FILTER(?t > 400000) }", f"SELECT {X}orders/' || o_orderkey AS o, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000"),
    "join_star": ('SELECT ?st (ROUND(SUM(?q)*100)/100 AS ?total) WHERE { ?l v:l_quantity ?q ; v:l_linestatus ?st ; v:l_returnflag "R" } GROUP BY ?st', "SELECT l_linestatus AS st, floor(sum(l_quantity) * 100 + 0.5) / 100 AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"),
    "join_chain4": (
        "SELECT ?r (COUNT(*) AS ?n) WHERE { ?l v:l_orderkey ?o . ?o v:o_custkey ?c . ?c v:c_nationkey ?k . ?k v:n_regionkey ?rk . ?rk v:r_name ?r } GROUP BY ?r",
        "SELECT r_name AS r, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "join_two_shared": ("SELECT ?l ?n WHERE { ?l v:l_suppkey ?s ; v:l_orderkey ?o . ?o v:o_custkey ?c . ?c v:c_nationkey ?n . ?s v:s_nationkey ?n . ?l v:l_quantity ?q FILTER(?q > 49) }", f"SELECT '_:' || concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS l, {X}nation/' || c_nationkey AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey WHERE l_quantity > 49"),
    "cross_small": ("SELECT ?a ?b WHERE { ?x v:r_name ?a . ?y v:r_name ?b }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b"),
    "theta": ("SELECT ?a ?b WHERE { ?x v:n_nationkey ?a . ?y v:r_regionkey ?b FILTER(?a < ?b) }", "SELECT n_nationkey AS a, r_regionkey AS b FROM nation JOIN region ON n_nationkey < r_regionkey"),
    "optional": ("SELECT ?d ?q WHERE { ?d v:n_chars ?n OPTIONAL { ?l v:labels ?d ; v:quality ?q } }", f"SELECT {X}documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "optional_filter": ("SELECT ?c ?o WHERE { ?c v:c_nationkey n:3 OPTIONAL { ?o v:o_custkey ?c ; v:o_totalprice ?t FILTER(?t > 400000) } }", f"SELECT {X}customer/' || c_custkey AS c, {X}orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE c_nationkey = 3"),
    "optional_then_join": (
        "SELECT ?d ?q ?k WHERE { ?d v:n_chars ?n FILTER(?n < 300) OPTIONAL { ?l v:labels ?d ; v:quality ?q } ?z v:quality ?q . ?z v:labels ?d . ?d v:doc_id ?k }",
        f"SELECT {X}documents/' || d.doc_id AS d, quality AS q, d.doc_id AS k FROM documents d JOIN labels l USING (doc_id) WHERE n_chars < 300",
    ),
    "minus": ("SELECT ?s WHERE { ?s a v:Nation MINUS { ?s v:n_regionkey <http://ex.org/region/1> } }", f"SELECT {X}nation/' || n_nationkey AS s FROM nation WHERE n_regionkey <> 1"),
    "minus_disjoint": ("SELECT ?s WHERE { ?s a v:Region MINUS { ?x v:n_name ?y } }", f"SELECT {X}region/' || r_regionkey AS s FROM region"),
    "not_exists": ("SELECT ?c WHERE { ?c a v:Customer FILTER NOT EXISTS { ?o v:o_custkey ?c ; v:o_totalprice ?t FILTER(?t > 200000) } }", f"SELECT {X}customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "exists": ("SELECT ?c WHERE { ?c v:c_acctbal ?b FILTER EXISTS { ?o v:o_custkey ?c ; v:o_totalprice ?t FILTER(?t > ?b * 60) } }", f"SELECT {X}customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60)"),
    "exists_expression": ("SELECT ?c WHERE { ?c v:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o v:o_custkey ?c ; v:o_totalprice ?t FILTER(?t > 480000) }) }", f"SELECT {X}customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)"),
    # -- algebra
    "select_all": ("SELECT * WHERE { ?r v:r_name ?name }", f"SELECT {X}region/' || r_regionkey AS r, r_name AS name FROM region"),
    "distinct": ("SELECT DISTINCT ?b ?t WHERE { ?p v:p_brand ?b ; v:p_type ?t }", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part"),
    "filter_error": ("SELECT ?n WHERE { ?s v:n_name ?n ; v:n_nationkey ?k FILTER(?n > 3 || ?k < 4) }", "SELECT n_name AS n FROM nation WHERE n_nationkey < 4"),
    "bind": ("SELECT ?o ?v WHERE { ?o v:o_totalprice ?t ; v:o_orderstatus \"P\" BIND(FLOOR(?t / 1000) AS ?v) }", f"SELECT {X}orders/' || o_orderkey AS o, floor(o_totalprice / 1000) AS v FROM orders WHERE o_orderstatus = 'P'"),
    "values_undef": ("SELECT ?k ?m ?n WHERE { ?x v:n_nationkey ?k ; v:n_name ?n VALUES (?k ?m) { (\"3\"^^xsd:int \"three\") (UNDEF \"any\") } FILTER(?k < 6) }", "SELECT n_nationkey AS k, m, n_name AS n FROM nation JOIN (VALUES (3, 'three'), (NULL, 'any')) t(kk, m) ON kk IS NULL OR kk = n_nationkey WHERE n_nationkey < 6"),
    "union_mixed": ("SELECT ?x ?name WHERE { { ?x v:n_name ?name } UNION { ?x v:r_name ?name } UNION { ?x v:s_suppkey ?k FILTER(?k < 3) } }", f"SELECT {X}nation/' || n_nationkey AS x, n_name AS name FROM nation UNION ALL SELECT {X}region/' || r_regionkey, r_name FROM region UNION ALL SELECT {X}supplier/' || s_suppkey, NULL FROM supplier WHERE s_suppkey < 3"),
    "subselect": ("SELECT ?n ?most WHERE { ?c v:c_nationkey ?k . ?k v:n_name ?n . { SELECT ?k (MAX(?b) AS ?most) WHERE { ?x v:c_nationkey ?k ; v:c_acctbal ?b } GROUP BY ?k } ?c v:c_acctbal ?most }", "SELECT n_name AS n, c_acctbal AS most FROM customer c JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey)"),
    # -- aggregates
    "agg_group": (
        "SELECT ?f ?st (ROUND(SUM(?q)*100)/100 AS ?sum_qty) (ROUND(SUM(?p*(1-?d))*100)/100 AS ?revenue) (ROUND(AVG(?d)*10000)/10000 AS ?avg_disc) (COUNT(*) AS ?n) WHERE { ?l v:l_returnflag ?f ; v:l_linestatus ?st ; v:l_quantity ?q ; v:l_extendedprice ?p ; v:l_discount ?d ; v:l_shipdate ?w FILTER(?w <= \"1998-09-02T00:00:00\"^^xsd:dateTime) } GROUP BY ?f ?st ORDER BY ?f ?st",
        "SELECT l_returnflag AS f, l_linestatus AS st, floor(sum(l_quantity)*100+0.5)/100 AS sum_qty, floor(sum(l_extendedprice*(1-l_discount))*100+0.5)/100 AS revenue, floor(avg(l_discount)*10000+0.5)/10000 AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "agg_having": ("SELECT ?k (COUNT(*) AS ?n) WHERE { ?c v:c_nationkey ?k } GROUP BY ?k HAVING(COUNT(*) > 60)", f"SELECT {X}nation/' || c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60"),
    "agg_distinct": ("SELECT (COUNT(DISTINCT ?b) AS ?brands) (COUNT(?b) AS ?n) (SUM(DISTINCT ?z) AS ?sizes) WHERE { ?p v:p_brand ?b ; v:p_size ?z }", "SELECT count(DISTINCT p_brand) AS brands, count(p_brand) AS n, sum(DISTINCT p_size)::BIGINT AS sizes FROM part"),
    "agg_minmax": ("SELECT ?t (MIN(?v) AS ?low) (MAX(?v) AS ?high) (MIN(?w) AS ?start) WHERE { ?e v:event_type ?t ; v:value ?v ; v:ts ?w } GROUP BY ?t", "SELECT event_type AS t, min(value) AS low, max(value) AS high, min(ts) AS start FROM events GROUP BY 1"),
    "agg_concat": ('SELECT ?r (GROUP_CONCAT(?n; SEPARATOR="|") AS ?names) WHERE { ?k v:n_regionkey ?x ; v:n_name ?n . ?x v:r_name ?r } GROUP BY ?r', "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "agg_sample_const": ("SELECT ?k (SAMPLE(?one) AS ?x) WHERE { ?c v:c_nationkey ?k BIND(1 AS ?one) } GROUP BY ?k", f"SELECT {X}nation/' || c_nationkey AS k, 1 AS x FROM customer GROUP BY 1"),
    "agg_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?sum) (AVG(?b) AS ?avg) (MIN(?b) AS ?min) WHERE { ?c v:c_acctbal ?b FILTER(?b > 1e9) }", "SELECT 0 AS n, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS avg, NULL::DOUBLE AS min"),
    "agg_expression_key": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o v:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    # -- modifiers
    "order_limit": ("SELECT ?o ?t WHERE { ?o v:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 10", f"SELECT {X}orders/' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, {X}orders/' || o_orderkey LIMIT 10"),
    "offset": ("SELECT ?n WHERE { ?s v:c_name ?n } ORDER BY ?n OFFSET 20 LIMIT 15", "SELECT c_name AS n FROM customer ORDER BY c_name LIMIT 15 OFFSET 20"),
    "order_mixed": ("SELECT ?x WHERE { { ?s v:n_name ?x } UNION { ?s v:n_nationkey ?x } UNION { ?s v:n_regionkey ?x } } ORDER BY ?x LIMIT 45", f"SELECT x FROM (SELECT 1 r, NULL::DOUBLE num, {X}region/' || n_regionkey AS x FROM nation UNION ALL SELECT 2, n_nationkey, n_nationkey::VARCHAR FROM nation) ORDER BY r, num, x LIMIT 45"),
    # -- forms
    "ask": ('ASK { ?o v:o_orderstatus "F" }', "SELECT count(*) > 0 AS ask FROM orders WHERE o_orderstatus = 'F'"),
    "construct": ("CONSTRUCT { ?r v:contains ?n . ?n v:inside ?name } WHERE { ?n v:n_regionkey ?r . ?r v:r_name ?name }", f"SELECT '<http://ex.org/region/' || n_regionkey || '>' AS s, '<http://ex.org/v#contains>' AS p, '<http://ex.org/nation/' || n_nationkey || '>' AS o FROM nation UNION SELECT '<http://ex.org/nation/' || n_nationkey || '>', '<http://ex.org/v#inside>', '\"' || r_name || '\"' FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "describe": ("DESCRIBE ?n WHERE { ?n v:n_regionkey <http://ex.org/region/2> }", f"SELECT '<http://ex.org/nation/' || n_nationkey || '>' AS s, unnest(['<' || {TYPE} || '>', '<http://ex.org/v#n_nationkey>', '<http://ex.org/v#n_name>', '<http://ex.org/v#n_regionkey>']) AS p, unnest(['<http://ex.org/v#Nation>', '\"' || n_nationkey || '\"^^<http://www.w3.org/2001/XMLSchema#int>', '\"' || n_name || '\"', '<http://ex.org/region/2>']) AS o FROM nation WHERE n_regionkey = 2"),
    # -- paths
    "path_seq": ("SELECT ?s ?r WHERE { ?s v:s_nationkey/v:n_regionkey/v:r_name ?r }", f"SELECT {X}supplier/' || s_suppkey AS s, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inv": ("SELECT ?r ?c WHERE { ?r ^v:n_regionkey/^v:c_nationkey ?c FILTER(?r = <http://ex.org/region/0>) }", f"SELECT {X}region/0' AS r, {X}customer/' || c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0"),
    "path_alt": ("SELECT ?x WHERE { ?x v:s_nationkey|v:c_nationkey n:4 }", f"SELECT {X}supplier/' || s_suppkey AS x FROM supplier WHERE s_nationkey = 4 UNION ALL SELECT {X}customer/' || c_custkey FROM customer WHERE c_nationkey = 4"),
    "path_plus": ('SELECT ?a ?b WHERE { ?a v:next+ ?b . ?a v:turn ?t . ?b v:role ?r FILTER(?t = 0) }', f"SELECT {X}conversations/' || a.conv_id || '/' || a.turn AS a, {X}conversations/' || b.conv_id || '/' || b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn WHERE a.turn = 0"),
    "path_star": ("SELECT ?b WHERE { <http://ex.org/conversations/1/0> v:next* ?b }", f"SELECT {X}conversations/1/' || turn AS b FROM conversations WHERE conv_id::VARCHAR = '1' UNION ALL SELECT {X}conversations/1/' || (max(turn) + 1) FROM conversations WHERE conv_id::VARCHAR = '1' HAVING count(*) > 0 UNION ALL SELECT {X}conversations/1/0' WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE conv_id::VARCHAR = '1')"),
    "path_opt": ("SELECT ?x WHERE { n:5 v:n_regionkey? ?x }", f"SELECT {X}nation/5' AS x UNION ALL SELECT {X}region/' || n_regionkey FROM nation WHERE n_nationkey = 5"),
    "path_neg": ("SELECT ?o WHERE { n:5 !(rdf:type|v:n_name) ?o }", f"SELECT unnest([n_nationkey::VARCHAR, {X}region/' || n_regionkey]) AS o FROM nation WHERE n_nationkey = 5"),
    # -- functions
    "fn_logic": ("SELECT ?k (IF(?k > 10, \"big\", \"small\") AS ?a) (COALESCE(?none, ?k) AS ?b) (?k IN (\"1\"^^xsd:int, 2, 3) AS ?c) (!(?k = 4) AS ?d) (BOUND(?none) AS ?e) WHERE { ?s v:n_nationkey ?k }", "SELECT n_nationkey AS k, if(n_nationkey > 10, 'big', 'small') AS a, n_nationkey AS b, n_nationkey IN (1, 2, 3) AS c, n_nationkey <> 4 AS d, false AS e FROM nation"),
    "fn_string": (
        'SELECT ?n (STRLEN(?n) AS ?a) (SUBSTR(?n, 2, 3) AS ?b) (UCASE(?n) AS ?c) (LCASE(?n) AS ?d) (STRSTARTS(?n, "P") AS ?e) (STRENDS(?n, "1") AS ?f) (CONTAINS(?n, "art") AS ?g) (STRBEFORE(?n, "_") AS ?h) (STRAFTER(?n, "_") AS ?i) (ENCODE_FOR_URI(CONCAT(?n, " *~")) AS ?j) WHERE { ?s v:p_name ?n }',
        "SELECT p_name AS n, length(p_name) AS a, substr(p_name, 2, 3) AS b, upper(p_name) AS c, lower(p_name) AS d, starts_with(p_name, 'P') AS e, ends_with(p_name, '1') AS f, contains(p_name, 'art') AS g, if(contains(p_name, '_'), split_part(p_name, '_', 1), '') AS h, if(contains(p_name, '_'), substr(p_name, instr(p_name, '_') + 1), '') AS i, replace(replace(p_name, '#', '%23'), ' ', '%20') || '%20%2A~' AS j FROM part",
    ),
    "fn_regex": ('SELECT ?n (REPLACE(?n, "[aeiou]", "*") AS ?r) (REPLACE(?n, "(.)_", "$1-", "i") AS ?q) WHERE { ?s v:n_name ?n FILTER(REGEX(?n, "^nation_1", "i")) }', "SELECT n_name AS n, regexp_replace(n_name, '[aeiou]', '*', 'g') AS r, regexp_replace(n_name, '(.)_', '\\1-', 'gi') AS q FROM nation WHERE regexp_matches(n_name, '(?i)^nation_1')"),
    "fn_regex_prefix": ('SELECT ?s WHERE { ?s v:c_name ?n FILTER(REGEX(?n, "^Customer")) }', f"SELECT {X}customer/' || c_custkey AS s FROM customer WHERE starts_with(c_name, 'Customer')"),
    "fn_numeric": ("SELECT ?s (ABS(-?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (?b * 2 - 1 AS ?m) (?b / 4 AS ?q) (-?b AS ?n) WHERE { ?s v:s_acctbal ?b }", f"SELECT {X}supplier/' || s_suppkey AS s, abs(s_acctbal) AS a, floor(s_acctbal + 0.5) AS r, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, s_acctbal * 2 - 1 AS m, s_acctbal / 4 AS q, -s_acctbal AS n FROM supplier"),
    "fn_integer_division": ("SELECT ?k (?k / 4 AS ?q) (?k + 1 AS ?p) (DATATYPE(?k / 4) AS ?d) WHERE { ?s v:n_nationkey ?k }", "SELECT n_nationkey AS k, n_nationkey / 4.0::DOUBLE AS q, n_nationkey + 1 AS p, 'http://www.w3.org/2001/XMLSchema#decimal' AS d FROM nation"),
    "fn_date": ("SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?a) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (SECONDS(?d) AS ?s) (TZ(?d) AS ?z) WHERE { ?o v:o_orderdate ?d ; v:o_orderstatus \"P\" }", f"SELECT {X}orders/' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS a, hour(o_orderdate) AS h, minute(o_orderdate) AS i, second(o_orderdate)::DOUBLE AS s, '' AS z FROM orders WHERE o_orderstatus = 'P'"),
    "fn_hash": ("SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?s v:n_name ?n }", "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    "fn_cast": ('SELECT ?k (xsd:string(?k) AS ?a) (xsd:double(?k) AS ?b) (xsd:boolean(?k) AS ?c) (xsd:integer("12") AS ?d) (xsd:integer(?n) AS ?e) (xsd:decimal("1.5") AS ?f) (STR(xsd:date("2020-01-02")) AS ?g) WHERE { ?s v:n_nationkey ?k ; v:n_name ?n }', "SELECT n_nationkey AS k, n_nationkey::VARCHAR AS a, n_nationkey::DOUBLE AS b, n_nationkey <> 0 AS c, 12 AS d, NULL::BIGINT AS e, 1.5::DOUBLE AS f, '2020-01-02' AS g FROM nation"),
    "fn_lang": ('SELECT ?l (COUNT(*) AS ?n) WHERE { ?d v:text ?t BIND(LANG(?t) AS ?l) FILTER(langMatches(?l, "fr") || langMatches(?l, "de")) } GROUP BY ?l', "SELECT lang AS l, count(text) AS n FROM documents WHERE lang IN ('fr', 'de') GROUP BY 1"),
    "fn_terms": ('SELECT ?k (STR(?s) AS ?a) (isIRI(?s) AS ?b) (isNumeric(?k) AS ?c) (DATATYPE(?k) AS ?d) (IRI(CONCAT("http://e/", STR(?k))) AS ?e) (sameTerm(?s, n:3) AS ?f) (STRDT(STR(?k), xsd:double) AS ?g) (LANG(STRLANG("x", "EN")) AS ?h) WHERE { ?s v:n_nationkey ?k }', f"SELECT n_nationkey AS k, {X}nation/' || n_nationkey AS a, true AS b, true AS c, 'http://www.w3.org/2001/XMLSchema#int' AS d, 'http://e/' || n_nationkey AS e, n_nationkey = 3 AS f, n_nationkey::DOUBLE AS g, 'en' AS h FROM nation"),
    "fn_boolean": ("SELECT ?t (COUNT(*) AS ?n) WHERE { ?l v:toxic ?t FILTER(?t || !?t) } GROUP BY ?t", "SELECT toxic = 1 AS t, count(*) AS n FROM labels GROUP BY 1"),
    "fn_gyear": ('SELECT ?y (COUNT(*) AS ?n) WHERE { ?o v:o_year ?y FILTER(?y >= "1996"^^xsd:gYear) } GROUP BY ?y', "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1"),
    "fn_not_in": ("SELECT ?k (?k NOT IN (1, 2, 3) AS ?c) WHERE { ?s v:n_nationkey ?k }", "SELECT n_nationkey AS k, n_nationkey NOT IN (1, 2, 3) AS c FROM nation"),
    "fn_sha2": ("SELECT ?n (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) (SHA256(?n) AS ?c) WHERE { ?s v:n_name ?n }", "SELECT n_name AS n, 96 AS a, 128 AS b, sha256(n_name) AS c FROM nation"),
    "is_literal": ("SELECT ?p (COUNT(*) AS ?n) FROM g:nation WHERE { ?s ?p ?o FILTER(isLiteral(?o)) } GROUP BY ?p", f"SELECT {X}v#n_name' AS p, count(*) AS n FROM nation UNION ALL SELECT {X}v#n_nationkey', count(*) FROM nation"),
    "fn_bnode": ('SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?b) AS ?texts) (COUNT(DISTINCT ?c) AS ?fresh) WHERE { ?s v:n_name ?x BIND(BNODE("a") AS ?b) BIND(BNODE() AS ?c) }', "SELECT count(*) AS n, count(*) AS texts, count(*) AS fresh FROM nation"),
    "fn_fresh": ('SELECT (COUNT(DISTINCT ?u) AS ?uuids) (COUNT(DISTINCT ?t) AS ?texts) (COUNT(*) AS ?n) WHERE { ?s v:n_name ?x BIND(UUID() AS ?u) BIND(STRUUID() AS ?t) BIND(RAND() AS ?r) FILTER(?r >= 0 && ?r < 1 && NOW() > "2020-01-01T00:00:00"^^xsd:dateTime) }', "SELECT count(*) AS uuids, count(*) AS texts, count(*) AS n FROM nation"),
    "reduced": ("SELECT (COUNT(DISTINCT ?k) AS ?n) WHERE { SELECT REDUCED ?k WHERE { ?c v:c_nationkey ?k } }", "SELECT count(DISTINCT c_nationkey) AS n FROM customer"),
    "exists_outer_variable": ("SELECT ?c WHERE { ?c v:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o v:o_custkey ?c ; v:o_totalprice ?t FILTER(?t > ?b * 300) }) }", f"SELECT {X}customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 300)"),
    "minus_optional": (
        "SELECT ?d ?q WHERE { ?d v:n_chars ?n OPTIONAL { ?l v:labels ?d ; v:quality ?q } MINUS { ?x v:labels ?d ; v:quality ?q ; v:toxic true } }",
        f"SELECT {X}documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS NULL OR toxic = 0",
    ),
    "iri_objects": ("SELECT ?p ?u WHERE { ?p v:url ?u FILTER(isIRI(?u)) }", f"SELECT {X}pages/' || page_id AS p, url AS u FROM pages"),
}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, as the oracles give them."""
    return df.select(*[F.col(f"`{n}`").cast("double").alias(n) if kind.startswith("decimal") else F.col(f"`{n}`") for n, kind in df.dtypes])


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: comparable(QuadStore.tables(spark, sf_dir).sparql(PREFIXES + text))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera.loaded_queries import QUERIES as LOADED
    from tessera.operators.dictionary import QUERIES as DICTIONARY

    return {k: _runner(text) for k, (text, _) in QUERIES.items()} | {k: f for k, (f, _) in (DICTIONARY | LOADED).items()}


def oracle_sql() -> dict[str, str]:
    from tessera.loaded_queries import QUERIES as LOADED
    from tessera.operators.dictionary import QUERIES as DICTIONARY

    return {k: sql for k, (_, sql) in QUERIES.items()} | {k: sql for k, (_, sql) in (DICTIONARY | LOADED).items() if sql}
