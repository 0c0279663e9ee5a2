"""Bindings of text, category, scoring and cleaning operators (T, K, S, J, A, B) to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categorise, clean, scoring, text
from .registry import query, rounded
from .views import Views

BAG = "SELECT package, lower(trim(keyword)) AS keyword, max(weight) AS weight, bool_or(visible) AS visible FROM (SELECT package, keyword, weight, visible FROM keywords UNION ALL SELECT package, kind, 5e0, false FROM packages) s GROUP BY ALL"


def _bag(v: Views):
    kinds = v.packages.selectExpr("package", "kind AS keyword", "5e0 AS weight", "false AS visible")
    return text.gather_keywords(v.keywords.select("package", "keyword", "weight", "visible").unionByName(kinds))


@query("t1_gather_keywords", BAG)
def _(v: Views):
    return _bag(v)


SYN = "(VALUES ('small', 'little', 9e-1), ('little', 'tiny', 5e-1), ('economy', 'cheap', 6e-1), ('standard', 'small', 7e-1)) syn(find, new, r)"


@query("t2_add_synonyms", f"""WITH bag AS ({BAG}), h1 AS (SELECT package, new AS keyword, max(weight * least(r, 8e-1)) AS weight FROM bag JOIN {SYN} ON find = keyword GROUP BY ALL), a1 AS (SELECT * FROM h1 WHERE (package, keyword) NOT IN (SELECT package, keyword FROM bag)), b1 AS (SELECT * FROM bag UNION ALL SELECT *, false FROM a1),
h2 AS (SELECT package, new AS keyword, max(weight * least(r, 8e-1)) AS weight FROM a1 JOIN {SYN} ON find = keyword GROUP BY ALL), a2 AS (SELECT * FROM h2 WHERE (package, keyword) NOT IN (SELECT package, keyword FROM b1))
SELECT package, keyword, round(weight, 6) AS weight, visible FROM (SELECT * FROM b1 UNION ALL SELECT *, false FROM a2) x""")
def _(v: Views):
    syn = v.spark.createDataFrame([("small", "little", 0.9), ("little", "tiny", 0.5), ("economy", "cheap", 0.6), ("standard", "small", 0.7)], "find string, replace string, relevance double")
    return rounded(text.add_synonyms(_bag(v), syn), "weight")


@query("t3_conditional_stopwords", f"""WITH bag AS ({BAG}), rules(rk, word) AS (VALUES ('economy', 'brand#1-red'), ('economy', 'brand#2-small'), ('promo', NULL), ('small', 'brand#3-blue')), hit AS (SELECT package, word FROM bag JOIN rules ON rk = keyword)
SELECT b.package, b.keyword, round(weight / pow(3e0, (SELECT count(*) FROM hit h WHERE h.package = b.package AND h.word = b.keyword)) / pow(2e0, (SELECT count(*) FROM bag x JOIN rules ON rk = x.keyword WHERE word IS NULL AND x.package = b.package AND x.keyword <> b.keyword)), 6) AS weight, visible FROM bag b""")
def _(v: Views):
    rules = v.spark.createDataFrame([("economy", "brand#1-red"), ("economy", "brand#2-small"), ("promo", None), ("small", "brand#3-blue")], "keyword string, word string")
    return rounded(text.conditional_stopwords(_bag(v), rules), "weight")


@query("t4_auto_keywords")
def _(v: Views):
    return text.auto_keywords(v.documents)


@query("t5_section_phrases", """WITH s AS (SELECT p_partkey % 100 AS package, p_partkey AS place, CASE p_size % 5 WHEN 0 THEN 'Overview' WHEN 1 THEN '' WHEN 2 THEN 'Usage' WHEN 3 THEN 'License' ELSE 'Other' END AS title, repeat(concat(p_name, '  and '), 1 + p_size % 4) AS t FROM part),
r AS (SELECT package, place, CASE WHEN title = 'Overview' THEN 1e0 WHEN title = '' THEN 6e-1 WHEN title = 'Usage' THEN 5e-1 WHEN title = 'License' THEN 1e-1 ELSE 4e-1 END AS relevance, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM s), u AS (SELECT *, sum(length(t)) OVER (PARTITION BY package ORDER BY relevance DESC, place) - length(t) AS used FROM r)
SELECT package, place, relevance, substr(t, 1, CAST(300 - used AS INT)) AS text FROM u WHERE used < 300""")
def _(v: Views):
    s = v.part.selectExpr("p_partkey % 100 AS package", "p_partkey AS place", "CASE p_size % 5 WHEN 0 THEN 'Overview' WHEN 1 THEN '' WHEN 2 THEN 'Usage' WHEN 3 THEN 'License' ELSE 'Other' END AS title", "repeat(concat(p_name, '  and '), 1 + p_size % 4) AS text")
    return text.section_phrases(s)


SENTENCES = r"s0 AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS place, unnest(a) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?\n]+') AS a FROM documents) x), sent AS (SELECT doc_id, place, trim(regexp_replace(regexp_replace(lower(s), '[0-9]+', '_', 'g'), '\s+', ' ', 'g')) AS sentence FROM s0), fine AS (SELECT * FROM sent WHERE length(sentence) > 16)"


@query("t6_normalise_sentences", f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, sum(length(sentence)) AS chars, min(sentence) AS first, max(place) AS last_place FROM fine GROUP BY doc_id")
def _(v: Views):
    return text.normalise_sentences(v.documents).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"), F.min("sentence").alias("first"), F.max("place").alias("last_place"))


@query("t6_folded_sentences", r"""WITH RECURSIVE l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
f AS (SELECT doc_id, n, list_transform(regexp_split_to_array(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[!?.;:] '), lambda x: translate(regexp_replace(x, '\b' || source || '\b|\bthe\b|[0-9]+', '_', 'gi'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS parts FROM l WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''),
walk(doc_id, n, parts, i, form, out) AS (SELECT doc_id, n, parts, 0, '', CAST(NULL AS VARCHAR) FROM f UNION ALL
SELECT doc_id, n, parts, i + 1, CASE WHEN strlen(j) > 16 THEN '' ELSE j END, CASE WHEN strlen(j) > 16 OR (i + 1 = len(parts) AND j <> '') THEN j END FROM (SELECT *, form || CASE WHEN form <> '' THEN ' ' ELSE '' END || parts[i + 1] AS j FROM walk WHERE i < len(parts)) w)
SELECT doc_id, count(*) AS n, CAST(sum(strlen(out)) AS BIGINT) AS n_bytes, min(out) AS first, max(out) AS last FROM walk WHERE out IS NOT NULL GROUP BY doc_id""")
def _(v: Views):
    d = v.documents.select("doc_id", "text", F.array("source", F.lit("the")).alias("own"))
    return text.folded_sentences(d, variables="own").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("sentence")).alias("n_bytes"), F.min("sentence").alias("first"), F.max("sentence").alias("last"))


@query("t7_unique_text", f"""WITH {SENTENCES}, r AS (SELECT f.*, row_number() OVER (PARTITION BY sentence ORDER BY n_chars DESC, f.doc_id) AS i, first_value(f.doc_id) OVER (PARTITION BY sentence ORDER BY n_chars DESC, f.doc_id) AS owner FROM fine f JOIN documents d ON d.doc_id = f.doc_id)
SELECT doc_id, count(*) AS n_sentences, sum(length(sentence)) AS n_chars, min(sentence) AS first_sentence FROM r WHERE doc_id = owner GROUP BY doc_id""")
def _(v: Views):
    return text.unique_text(text.normalise_sentences(v.documents), v.documents.select("doc_id", F.col("n_chars").alias("score")))


def _index(v: Views):
    return text.postings(v.packages.selectExpr("package", "name", "category AS keywords", "kind AS description"), "package", {"name": "name", "keywords": "keywords", "description": "description"})


WORDS = r"f AS (SELECT package, 'name' AS field, name AS t FROM packages UNION ALL SELECT package, 'keywords', category FROM packages UNION ALL SELECT package, 'description', kind FROM packages), w AS (SELECT package, field, unnest(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+')) AS term FROM f), idx AS (SELECT field, term, package, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL)"


@query("t8_postings", f"WITH {WORDS} SELECT * FROM idx")
def _(v: Views):
    return _index(v)


QUERY_TABLE = "q(query_id, q) AS (VALUES (1, 'small ring'), (2, 'red'), (3, 'economy bolt'), (4, 'blue widget brand'), (5, 'nothing'))"
SEARCH = f"""WITH {QUERY_TABLE}, {WORDS}, sizes AS (SELECT field, package, sum(tf) AS len FROM idx GROUP BY ALL), means AS (SELECT field, avg(len) AS mean, count(*) AS n_docs FROM sizes GROUP BY field), qw AS (SELECT DISTINCT query_id, unnest(string_split(q, ' ')) AS term FROM q), need AS (SELECT query_id, count(*) AS k FROM qw GROUP BY query_id),
dfs AS (SELECT field, term, count(*) AS df FROM idx GROUP BY ALL), per AS (SELECT i.term, i.package, sum(ln(1 + (n_docs - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (1 - 75e-2 + 75e-2 * len / mean)) * CASE i.field WHEN 'name' THEN 2e0 WHEN 'keywords' THEN 15e-1 ELSE 1e0 END) AS w FROM idx i JOIN sizes s ON s.field = i.field AND s.package = i.package JOIN means m ON m.field = i.field JOIN dfs d ON d.field = i.field AND d.term = i.term GROUP BY ALL),
found AS (SELECT qw.query_id, package, sum(w) AS relevance FROM qw JOIN per ON per.term = qw.term JOIN need ON need.query_id = qw.query_id GROUP BY qw.query_id, package, need.k HAVING count(*) = need.k),
sc AS (SELECT f.query_id, f.package, round(CASE WHEN lower(p.name) = q.q THEN 11e-1 * max(relevance) OVER (PARTITION BY f.query_id) ELSE relevance END * (p.rank + 1), 6) AS score FROM found f JOIN packages p ON p.package = f.package JOIN q ON q.query_id = f.query_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, package) AS pos FROM sc) r WHERE pos <= 60)"""


def _hits(v: Views):
    queries = v.spark.createDataFrame([(1, "small ring"), (2, "red"), (3, "economy bolt"), (4, "blue widget brand"), (5, "nothing")], "query_id int, text string")
    docs = v.packages.selectExpr("package", "name", "rank + 1 AS base_score")
    return text.search(_index(v), docs, queries, "package", 60, {"name": 2, "keywords": 1.5, "description": 1})


@query("t9_search", f"{SEARCH} SELECT query_id, package, round(score, 4) AS score FROM hits")
def _(v: Views):
    return rounded(_hits(v), "score", places=4).drop("pos")


def _division() -> str:
    """The rounds of T10, one after another."""
    steps = ["""r AS MATERIALIZED (SELECT query_id, doc_id, score / 1e5 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM results),
k AS MATERIALIZED (SELECT DISTINCT doc_id, keyword FROM (SELECT p_partkey AS doc_id, unnest([lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_brand), concat(split_part(p_name, ' ', 2), '-', p_size % 7)]) AS keyword FROM part) x),
q AS (SELECT DISTINCT query_id, ['ring', 'bolt', 'gear', 'widget'][query_id % 4 + 1] AS q FROM results),
bag AS (SELECT r.query_id, r.doc_id, pos, score, list_sort(list(keyword)) AS ks FROM r JOIN k ON k.doc_id = r.doc_id GROUP BY ALL),
one AS (SELECT query_id, ks, min(pos) AS pos, min_by(score, pos) AS score FROM bag GROUP BY query_id, ks),
st AS MATERIALIZED (SELECT query_id, row_number() OVER () AS set_id, q, list_filter(ks, lambda x: x <> q) AS ks, CASE WHEN pos <= 40 THEN 2048 ELSE 1024 END + CAST(trunc(128 * score) AS BIGINT) AS w0 FROM one JOIN q USING (query_id) WHERE NOT list_contains(ks, 'brand#13')),
n AS (SELECT query_id, count(*) AS n FROM st GROUP BY query_id HAVING count(*) >= 25),
ks AS MATERIALIZED (SELECT st.query_id, set_id, q, w0, unnest(ks) AS keyword FROM st JOIN n ON n.query_id = st.query_id),
ch0 AS (SELECT query_id, '' AS keyword FROM n WHERE false)"""]

    def popular(name: str, chosen: str, alive: str, ignored: str) -> None:
        steps.append(f"""{name}w AS MATERIALIZED (SELECT st.query_id, set_id, q, CASE WHEN EXISTS (SELECT 1 FROM ks JOIN {chosen} c ON c.query_id = ks.query_id AND c.keyword = ks.keyword WHERE ks.set_id = st.set_id) THEN -(w0 // 2) ELSE w0 END AS w FROM st WHERE query_id IN (SELECT query_id FROM {alive})),
{name}l AS MATERIALIZED (SELECT w.query_id, w.set_id, w.q, w.w, keyword FROM {name}w w JOIN ks ON ks.set_id = w.set_id WHERE NOT EXISTS (SELECT 1 FROM {chosen} c WHERE c.query_id = ks.query_id AND c.keyword = ks.keyword)),
{name}v AS (SELECT query_id, keyword, w FROM {name}l UNION ALL SELECT query_id, rest, 2 * w FROM (SELECT *, CASE WHEN starts_with(keyword, q || '-') THEN keyword[length(q) + 2:] WHEN ends_with(keyword, '-' || q) THEN keyword[:-length(q) - 2] END AS rest FROM {name}l) x WHERE rest IS NOT NULL AND w > 0 AND NOT EXISTS (SELECT 1 FROM {name}l y WHERE y.set_id = x.set_id AND y.keyword = x.rest)),
{name}c AS (SELECT v.query_id, keyword, n, count(*) AS pop, CASE WHEN keyword IN ('api', 'cli', 'rust') THEN CAST(sum(w) AS BIGINT) * 3 // 4 ELSE CAST(sum(w) AS BIGINT) END AS weight FROM {name}v v JOIN n ON n.query_id = v.query_id GROUP BY v.query_id, keyword, n),
{name} AS MATERIALIZED (SELECT c.query_id, min_by(c.keyword, (-weight * CASE WHEN pop >= 10 AND pop <= c.n // 3 THEN 2 ELSE 1 END, c.keyword)) AS keyword FROM {name}c c JOIN {alive} a ON a.query_id = c.query_id WHERE pop > 2 AND pop <= c.n * 3 // 4 AND {ignored} GROUP BY c.query_id)""")

    popular("p", "ch0", "n", "c.keyword NOT IN ('api', 'cli')")
    popular("x1", "ch0", "p", "c.keyword <> a.keyword")
    steps.append("ch1 AS (SELECT query_id, keyword, 1 AS pos FROM x1)")
    for i in range(1, 10):
        popular(f"y{i + 1}", f"ch{i}", f"x{i}", "c.keyword <> 'reserved' AND c.keyword <> a.keyword")
        steps.append(f"x{i + 1} AS MATERIALIZED (SELECT * FROM y{i + 1} y WHERE (SELECT count(*) FROM y{i + 1}w w WHERE w.query_id = y.query_id AND w.w > 0) >= 25 AND NOT EXISTS (SELECT 1 FROM ch{i} c WHERE c.query_id = y.query_id AND c.keyword = y.keyword)), ch{i + 1} AS MATERIALIZED (SELECT query_id, keyword, pos FROM ch{i} UNION ALL SELECT query_id, keyword, {i + 1} FROM x{i + 1})")
    return ", ".join([*steps, "d AS (SELECT query_id, keyword, pos FROM ch10)"])


DIVIDE = _division()


def _ranked(v: Views):
    from pyspark.sql.window import Window

    r = v.results.withColumn("score", F.col("score") / 100000)
    return r.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def _labels(v: Views):
    words = "array(lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_brand), concat(split_part(p_name, ' ', 2), '-', p_size % 7))"
    return v.part.select(F.col("p_partkey").alias("doc_id"), F.explode(F.expr(words)).alias("keyword")).distinct()


def _divided(v: Views):
    queries = v.results.select("query_id").distinct().withColumn("text", F.expr("array('ring', 'bolt', 'gear', 'widget')[query_id % 4]")).withColumn("query_keywords", F.array("text"))
    return text.dividing_keywords(_ranked(v), _labels(v), queries, 40, ("brand#13",)), queries


@query("t10_dividing_keywords", f"WITH {DIVIDE} SELECT * FROM d")
def _(v: Views):
    return _divided(v)[0]


@query("t11_promote_representatives", f"""WITH {DIVIDE}, pr AS (SELECT DISTINCT query_id, doc_id FROM (SELECT r.query_id, d.keyword, min_by(r.doc_id, r.pos) AS doc_id FROM r JOIN k ON k.doc_id = r.doc_id JOIN d ON d.query_id = r.query_id AND d.keyword = k.keyword WHERE d.pos <= 6 GROUP BY ALL) x),
f AS (SELECT r.query_id, r.doc_id, pos, score, (pos <= 3 AND count(*) OVER (PARTITION BY r.query_id) > 3) OR pr.doc_id IS NOT NULL AS front FROM r LEFT JOIN pr ON pr.query_id = r.query_id AND pr.doc_id = r.doc_id)
SELECT query_id, doc_id, front, row_number() OVER (PARTITION BY query_id ORDER BY front DESC, pos) AS new_pos, round(CASE WHEN front THEN greatest(score, max(score) FILTER (WHERE NOT front) OVER (PARTITION BY query_id)) ELSE score END, 8) AS score FROM f""")
def _(v: Views):
    return rounded(text.promote_representatives(_ranked(v), _divided(v)[0], _labels(v)), "score", places=8)


@query("t12_search_also", f"WITH {DIVIDE} SELECT d.query_id, keyword, concat(q, ' ', keyword) AS search, pos FROM d JOIN q ON q.query_id = d.query_id WHERE (SELECT count(*) FROM d e WHERE e.query_id = d.query_id) >= 3")
def _(v: Views):
    return text.search_also(*_divided(v))


@query("t12_did_you_mean", f"""WITH {DIVIDE}, c AS (SELECT d.*, q, count(*) OVER (PARTITION BY d.query_id) AS n FROM d JOIN q ON q.query_id = d.query_id)
SELECT query_id, keyword, concat(q, ' ', keyword) AS search, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM c WHERE n >= 5 AND NOT starts_with(keyword, q || '-') AND NOT ends_with(keyword, '-' || q)) x WHERE place <= 3""")
def _(v: Views):
    return text.did_you_mean(*_divided(v))


@query("t14_synonym_candidates", """WITH v AS (SELECT CASE p_size % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '-') || 's' END AS keyword FROM part), n AS (SELECT keyword, count(*) AS n, regexp_replace(regexp_replace(keyword, '[-_ ]', '', 'g'), 's$', '') AS key FROM v GROUP BY keyword),
b AS (SELECT *, first_value(keyword) OVER w AS best, first_value(n) OVER w AS best_n FROM n WINDOW w AS (PARTITION BY key ORDER BY n DESC, keyword)) SELECT keyword AS find, best AS replace, n AS votes FROM b WHERE keyword <> best AND best_n >= 2""")
def _(v: Views):
    k = v.part.selectExpr("CASE p_size % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '-') || 's' END AS keyword")
    return text.synonym_candidates(k)


BAGS = """k AS MATERIALIZED (SELECT DISTINCT doc_id, keyword FROM (SELECT p_partkey AS doc_id, unnest([lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_brand), concat(split_part(p_name, ' ', 2), '-', p_size % 7)]) AS keyword FROM part) x),
bag AS MATERIALIZED (SELECT doc_id, list_sort(list(keyword)) AS ks, max(p_retailprice) AS rank FROM k JOIN part ON p_partkey = doc_id GROUP BY doc_id)"""


def _stage(name: str, asked: str, without: str, words: str, bad: str) -> str:
    """Distinct sets of one step and their most common keyword."""
    return f"""{name}h AS (SELECT a.find, ks, row_number() OVER (PARTITION BY a.find ORDER BY rank DESC, k.doc_id) AS place, {words} AS words, {bad} AS bad FROM {asked} a JOIN k ON k.keyword = a.find JOIN bag ON bag.doc_id = k.doc_id WHERE NOT list_has_any(ks, {without})),
{name}s AS MATERIALIZED (SELECT DISTINCT find, list_filter(ks, lambda x: NOT list_contains(words, x)) AS ks FROM {name}h h WHERE place <= 300 AND NOT list_has_any(ks, bad) AND (SELECT count(*) FROM {name}h o WHERE o.find = h.find AND o.place <= 300) >= 25),
{name} AS MATERIALIZED (SELECT find, min_by(keyword, (-n, keyword)) AS keyword FROM (SELECT find, keyword, count(*) AS n FROM (SELECT find, unnest(ks) AS keyword FROM {name}s) u GROUP BY ALL) v GROUP BY find)"""


def _peeled(rounds: int = 5) -> str:
    steps = [BAGS, "f AS (SELECT DISTINCT keyword AS find FROM k)", _stage("p0", "f", "CAST([] AS VARCHAR[])", "[a.find, 'small']", "['brand#13']")]
    for i in range(1, rounds + 1):
        steps.append(f"""p{i}s AS MATERIALIZED (SELECT s.* FROM p{i - 1}s s JOIN p{i - 1} p ON p.find = s.find WHERE NOT list_contains(ks, p.keyword)),
p{i} AS MATERIALIZED (SELECT find, min_by(keyword, (-n, keyword)) AS keyword FROM (SELECT find, keyword, count(*) AS n FROM (SELECT find, unnest(ks) AS keyword FROM p{i}s) u GROUP BY ALL) v WHERE (SELECT count(*) FROM p{i}s s WHERE s.find = v.find) >= 50 GROUP BY find)""")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT find, keyword, {i} AS pos FROM p{i}" for i in range(rounds + 1))


@query("t14_related_keywords", _peeled())
def _(v: Views):
    k = _labels(v)
    asked = k.select(F.col("keyword").alias("find")).distinct().select("find", F.expr("CAST(array() AS array<string>)").alias("without"), F.array("find", F.lit("small")).alias("words"), F.array(F.lit("brand#13")).alias("bad"))
    return text.related_keywords(k, v.part.selectExpr("p_partkey AS doc_id", "p_retailprice AS rank"), asked)


def _list(*parts: str) -> str:
    return f"CAST([{', '.join(parts)}] AS VARCHAR[])"


def _splits() -> str:
    fixed = lambda words: [f"'{w}'" for w in words]
    w, b = text.SPLIT_WORDS, text.SPLIT_RESULTS
    return "WITH " + ", ".join([
        BAGS, "f AS (SELECT DISTINCT keyword AS find FROM k)",
        _stage("a1", "f", _list(), _list("a.find", *fixed(w[0])), _list(*fixed(b[0]))), "f1 AS (SELECT find, keyword AS related FROM a1)",
        _stage("a2", "f1", _list("related"), _list("a.find", *fixed(w[1])), _list("related", *fixed(b[1]))), "f2 AS (SELECT f1.*, keyword AS first FROM f1 JOIN a2 ON a2.find = f1.find)",
        _stage("a3", "f2", _list("first"), _list("a.find", "related", *fixed(w[2])), _list("first", *fixed(b[2]))), "f3 AS (SELECT f2.*, keyword AS second FROM f2 JOIN a3 ON a3.find = f2.find)",
        _stage("a4", "f3", _list("first", "second"), _list("a.find", "related", *fixed(w[3])), _list("first", "second", *fixed(b[3]))),
    ]) + " SELECT f3.*, keyword AS third FROM f3 LEFT JOIN a4 ON a4.find = f3.find"


@query("t14_keyword_splits", _splits())
def _(v: Views):
    k = _labels(v)
    return text.keyword_splits(k, v.part.selectExpr("p_partkey AS doc_id", "p_retailprice AS rank"), k.select(F.col("keyword").alias("find")).distinct())


@query("t15_keyword_page", "SELECT keyword, package, pos FROM (SELECT k.keyword, k.package, row_number() OVER (PARTITION BY k.keyword ORDER BY p.rank DESC, k.package) AS pos FROM (SELECT DISTINCT keyword, package FROM keywords) k JOIN packages p ON p.package = k.package) r WHERE pos <= 250")
def _(v: Views):
    return text.keyword_page(v.keywords, v.packages)


CANDIDATES = """WITH src AS (SELECT keyword, sum(weight) AS total FROM keywords GROUP BY keyword), cat AS (SELECT package, slug, relevance FROM categories WHERE relevance < 1),
per AS (SELECT k.package, o.package AS other, k.keyword, o.weight AS ow, k.weight / (8000 + s.total) AS mine FROM keywords k JOIN src s ON s.keyword = k.keyword JOIN keywords o ON o.keyword = k.keyword AND o.package <> k.package),
sums AS (SELECT per.package, slug, sum(relevance * ow * mine) / (8 + count(*)) AS w FROM per JOIN cat c ON c.package = per.other GROUP BY ALL)"""


@query("k1_candidate_categories", f"{CANDIDATES} SELECT package, slug, round(w, 9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY round(w, 9) DESC, slug) AS pos FROM sums) r WHERE pos <= 10")
def _(v: Views):
    return categorise.candidate_categories(v.keywords, v.categories.where("relevance < 1"))


K2_RULES = [
    {"kind": "any", "keywords": ["small", "economy"], "slug": "cheap", "mul": 1.1, "add": 0.2},
    {"kind": "all", "keywords": ["promo", "brand#1-red"], "slug": "PROMO", "mul": 1.3, "add": 0.0},
    {"kind": "not_any", "keywords": ["standard"], "slug": "STANDARD", "mul": 0.5, "add": 0.0},
    {"kind": "any", "keywords": ["brand#1-red", "brand#1-blue", "brand#2-red", "brand#2-blue"], "slug": "Brand#1", "mul": 1.2, "add": 0.15},
    {"kind": "not_any", "keywords": ["economy"], "slug": "cheap", "mul": 1.0, "add": 0.25},
]
K2_TREE = [("cheap", None), ("ECONOMY", "cheap"), ("SMALL", "cheap"), ("Brand#1", "SMALL"), ("PROMO", None)]
K2_EXCLUDE, K2_RIVALS, K2_LATE, K2_LIKED = [("ECONOMY", "cheap"), ("cheap", "LARGE")], [("cheap", "Brand#1"), ("SMALL", "cheap")], [("Brand#1", "STANDARD"), ("SMALL", "Brand#1")], {"cheap": 0.9, "SMALL": 1.1}


def _adjusted() -> str:
    """The steps of K2 as one query, a CTE a step."""
    names = lambda words: ", ".join(f"'{w}'" for w in words)
    steps = [f"bag AS ({BAG})", "s0 AS (SELECT package, slug, CAST(max(relevance) AS DOUBLE) AS weight FROM categories GROUP BY package, slug)", "everyone AS (SELECT package FROM bag UNION SELECT package FROM s0)"]
    at = 0

    def add(sql: str) -> None:
        nonlocal at
        at += 1
        steps.append(f"s{at} AS ({sql})")

    for i, r in enumerate(K2_RULES):
        hits = f"SELECT package, count(DISTINCT keyword) AS hits FROM bag WHERE keyword IN ({names(r['keywords'])}) GROUP BY package"
        found = {"any": f"SELECT package, sqrt(hits) AS r FROM ({hits}) h", "all": f"SELECT package, 1e0 AS r FROM ({hits}) h WHERE hits = {len(r['keywords'])}", "not_any": f"SELECT package, 1e0 AS r FROM everyone WHERE package NOT IN (SELECT package FROM ({hits}) h)"}[r["kind"]]
        steps.append(f"m{i} AS (SELECT package, '{r['slug']}' AS slug, r FROM ({found}) f)")
        add(f"SELECT coalesce(s.package, m.package) AS package, coalesce(s.slug, m.slug) AS slug, CASE WHEN m.r IS NULL THEN s.weight ELSE coalesce(s.weight, 0e0) * pow({r['mul']}e0, m.r) + {r['add']}e0 * m.r + 1e-6 END AS weight FROM s{at} s FULL JOIN m{i} m ON m.package = s.package AND m.slug = s.slug")

    def of(slug: str, alias: str) -> str:
        return f"LEFT JOIN (SELECT package, weight AS w FROM s{at} WHERE slug = '{slug}') {alias} ON {alias}.package = s.package"

    def exclude(pairs: list) -> None:
        for a, b in pairs:
            add(f"SELECT s.package, slug, weight - CASE WHEN slug = '{b}' AND a.w IS NOT NULL THEN least(a.w, weight / 3) ELSE 0e0 END AS weight FROM s{at} s {of(a, 'a')}")

    exclude(K2_EXCLUDE)
    own = at
    for slug, parent in K2_TREE:
        add(f"SELECT s.package, slug, weight + CASE WHEN slug = '{slug}' THEN least(weight, coalesce(a.w / 2, 0e0)) ELSE 0e0 END AS weight FROM s{at} s {of(parent or '', 'a')}")
    steps.append("branch AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{p}')" for s, p in K2_TREE if p) + ") t(child, parent))")
    add(f"SELECT s.package, s.slug, s.weight + coalesce(greatest(b.w, 0e0), 0e0) / 6 AS weight FROM s{at} s LEFT JOIN (SELECT package, parent, max(weight) AS w FROM s{own} JOIN branch ON child = slug GROUP BY package, parent) b ON b.package = s.package AND b.parent = s.slug")
    for a, b in K2_RIVALS:
        add(f"SELECT s.package, slug, CASE WHEN a.w * 66e-2 > b.w THEN CASE slug WHEN '{a}' THEN weight + b.w / 2 WHEN '{b}' THEN weight * 5e-1 ELSE weight END WHEN b.w * 66e-2 > a.w THEN CASE slug WHEN '{b}' THEN weight + a.w / 2 WHEN '{a}' THEN weight * 5e-1 ELSE weight END ELSE weight END AS weight FROM s{at} s {of(a, 'a')} {of(b, 'b')}")
    exclude(K2_LATE)
    liked = " ".join(f"WHEN '{s}' THEN {w}e0" for s, w in K2_LIKED.items())
    steps.append(f"final AS (SELECT package, slug, round(weight * CASE slug {liked} ELSE 1e0 END, 6) AS weight FROM s{at})")
    return "WITH " + ", ".join(steps) + " SELECT package, slug, weight FROM (SELECT *, round(greatest(1e-1, 951e-3 * max(weight) OVER (PARTITION BY package)), 6) AS least_weight, row_number() OVER (PARTITION BY package ORDER BY weight DESC, slug) AS pos FROM final) f WHERE weight >= least_weight AND pos <= 3"


@query("k2_adjust_categories", _adjusted())
def _(v: Views):
    cands = v.categories.groupBy("package", "slug").agg(F.max("relevance").alias("weight"))
    return categorise.adjust_categories(cands, _bag(v), K2_RULES, K2_EXCLUDE, tree=K2_TREE, rivals=K2_RIVALS, late_exclusions=K2_LATE, preference=K2_LIKED, most=3)


@query("k3_category_weights", """SELECT package, slug, round(relevance / max(relevance) OVER (PARTITION BY package) * CASE WHEN relevance >= 5e-1 THEN 1e0 ELSE 4e-1 END * CASE WHEN slug LIKE 'Brand%' THEN 8e-1 ELSE 1e0 END, 6) AS rank_weight FROM categories""")
def _(v: Views):
    c = v.categories.withColumns({"explicit": F.col("relevance") >= 0.5, "is_general": F.col("slug").startswith("Brand")})
    return rounded(categorise.category_weights(c), "rank_weight")


@query("k4_top_keywords", """WITH a AS (SELECT keyword, avg(weight) AS mean FROM keywords GROUP BY keyword), s AS (SELECT k.package, k.keyword, round(mean * k.weight, 6) AS score FROM keywords k JOIN a ON a.keyword = k.keyword WHERE visible AND k.keyword NOT IN (SELECT slug FROM categories)), m AS (SELECT *, max(score) OVER (PARTITION BY package) AS top FROM s)
SELECT package, keyword, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY score DESC, keyword) AS pos FROM m WHERE score >= top / 20) r WHERE pos <= 10""")
def _(v: Views):
    return categorise.top_keywords(v.keywords, v.categories)


FEATURES = "SELECT p_partkey AS package, p_size * 10 AS description_len, p_size % 2 = 0 AS has_links, p_size % 3 = 0 AS has_build, p_size % 5 = 0 AS has_examples, p_size % 4 = 0 AS has_tests, false AS has_conduct, p_size % 9 = 0 AS has_benches, p_size > 10 AS has_docs, p_size > 20 AS has_homepage, p_size > 5 AS has_repo, p_size > 25 AS is_verified, p_size % 12 AS n_keywords, p_size % 7 AS n_categories, p_size % 6 AS n_features, p_size % 3 AS n_badges, true AS on_stable, 2015 + 3 * (p_size % 3) AS edition, p_size % 8 > 0 AS useful_license, p_size * 100 AS text_len, p_size * 20 AS code_len, p_size % 5 AS n_pre, p_size % 3 AS n_images, p_size % 11 AS n_sections, p_size % 17 AS n_rows, p_partkey % 4 AS n_live, p_partkey % 5 AS n_releases, p_partkey % 900 AS history_days, 2015 + p_size % 6 AS last_year, p_size % 19 AS n_proper, p_size % 4 AS n_stable_patches, p_size % 13 AS max_patch, p_size % 2 = 1 AS zero_patched, p_size % 4 AS n_stable, p_size % 3 AS n_yanked, p_size % 6 AS n_owners, p_size % 8 AS n_authors, p_size % 50 AS n_contributors, p_partkey % 9000 AS code_lines, p_partkey % 700 AS comment_lines FROM {part}"


def _sql_score(rules: list[tuple[float, str]]) -> str:
    return "(" + " + ".join(f"greatest(0e0, least(coalesce(CAST({x} AS DOUBLE), 0e0), {m}e0))" for m, x in rules) + f") / {sum(m for m, _ in rules)}e0"


def _on(x: str, m: int) -> str:
    return f"CASE WHEN {x} THEN {m} ELSE 0 END"


MANIFEST = _sql_score([(30, "description_len / 300 * 30"), (10, "CASE WHEN has_links THEN 5 WHEN NOT has_build THEN 10 ELSE 0 END"), (5, _on("has_examples", 5)), (5, _on("has_tests", 5)), (10, _on("has_conduct", 10)), (5, _on("has_benches", 5)), (30, _on("has_docs", 30)), (20, _on("has_homepage", 20)), (10, _on("has_repo", 10)), (15, _on("is_verified", 15)), (8, "n_keywords"), (6, "n_categories"), (4, "n_features"), (1, "n_badges"), (20, _on("on_stable", 20)), (5, "CASE WHEN edition >= 2021 THEN 5 WHEN edition >= 2018 THEN 4 ELSE 0 END"), (10, _on("useful_license", 10))])
README = _sql_score([(75, "text_len / 3000 * 75"), (100, "code_len / 2000 * 100"), (25, "n_pre * 5"), (30, _on("code_len > 150 AND n_pre > 0", 30)), (35, "n_images * 25"), (30, "n_sections * 4"), (25, "n_rows * 2")])
CODE = _sql_score([(1, _on("code_lines > 700", 1)), (1, _on("code_lines < 80000", 1)), (2, "code_lines / 5000 * 2"), (2, "10 * comment_lines / (3000 + code_lines) * 2")])
VERSIONS = _sql_score([(20, _on("n_releases > 1", 20))] + [(m, f"CASE WHEN n_live > 0 THEN {x} ELSE 0 END") for m, x in [(40, "history_days / 11"), (10, _on("last_year > 2017", 10)), (15, "n_proper"), (20, "4 * n_stable_patches"), (10, "max_patch"), (8, _on("zero_patched", 8)), (5, _on("n_pre > 0", 5)), (10, _on("n_stable > 0", 10)), (2, _on("n_yanked > 0", 2))]])
PEOPLE = _sql_score([(3, _on("n_owners > 1", 3)), (4, "n_owners"), (5, "n_authors"), (7, "n_contributors / 7")])


@query("s2_static_score", f"WITH feats AS ({FEATURES.replace('{part}', 'part')}) SELECT package, round({_sql_score([(2, f'({MANIFEST}) * 2'), (5, f'({README}) * 5'), (2, f'({CODE}) * 2'), (5, f'({VERSIONS}) * 5'), (3, f'({PEOPLE}) * 3')])}, 6) AS static_score FROM feats")
def _(v: Views):
    return rounded(scoring.static_score(v.spark.sql(FEATURES, part=v.part)).select("package", "static_score"), "static_score")


TIMES = "SELECT p_partkey AS package, p_size % 3 AS major, p_size % 5 AS minor, p_size % 12 AS patch, 1 + p_size % 20 AS n_releases, p_size % 10 = 0 AS is_nightly, p_size % 6 = 0 AS is_app_only, p_partkey * 13 % 1500 AS age_days, p_partkey * 7 % 500000 AS cleaned_downloads, p_size % 40 AS direct_users, p_size / 25 AS growth, p_size / 50 AS dep_freshness, p_partkey * 11 % 900000 AS downloads, p_size % 10 / 10 AS external_usage, p_size % 90 AS active_users, p_size % 300 AS indirect_users, p_size > 10 AS has_docs FROM {part}"
_INTERVAL = "(least(CASE WHEN major > 0 AND patch > 3 THEN 700 WHEN major > 0 THEN 450 WHEN patch > 10 THEN 300 WHEN patch > 3 THEN 200 WHEN minor > 1 THEN 140 ELSE 80 END, 50 * n_releases) / CASE WHEN is_nightly THEN 4 ELSE 1 END)"
TEMPORAL = _sql_score([(2, "CASE WHEN NOT is_app_only THEN growth - 1 END"), (14, f"14 * greatest(0e0, least(1e0, 1 - (age_days - {_INTERVAL}) / ({_INTERVAL} / 2 + CASE WHEN is_nightly THEN 30 WHEN is_app_only THEN 300 ELSE 200 END)))"), (10, "10 * dep_freshness"), (5, "(log2(greatest(downloads, 150)) - 6) / CASE WHEN is_app_only THEN 5 ELSE 6 END"), (17, "log2(greatest(cleaned_downloads, 1)) - 5"), (2, "2 * external_usage"), (8, "CASE WHEN NOT is_app_only THEN sqrt(active_users) END"), (10, "CASE WHEN NOT is_app_only THEN sqrt(direct_users) END"), (6, "CASE WHEN NOT is_app_only THEN log2(1 + indirect_users / 4) END"), (1, _on("has_docs", 1))])


@query("s3_temporal_score", f"WITH feats AS ({TIMES.replace('{part}', 'part')}) SELECT package, round({TEMPORAL}, 6) AS temporal_score FROM feats")
def _(v: Views):
    return rounded(scoring.temporal_score(v.spark.sql(TIMES, part=v.part)).select("package", "temporal_score"), "temporal_score")


@query("s4_combined_score", """SELECT p_partkey AS package, round((4e-1 * p_size / 50 + 5e-1 * (p_partkey % 100) / 100 + 1e-1 * greatest(p_size / 50, (p_partkey % 100) / 100)) * CASE WHEN p_size % 2 = 0 THEN 9e-1 ELSE 1e0 END * CASE WHEN p_size % 3 = 0 THEN 8e-1 ELSE 1e0 END * CASE WHEN p_size % 5 = 0 THEN 5e-1 ELSE 1e0 END * CASE WHEN p_size % 7 = 0 THEN 2e-1 ELSE 1e0 END * CASE WHEN p_size % 11 = 0 THEN 1e-3 ELSE 1e0 END * 9e-1, 6) AS score FROM part""")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "p_size / 50 AS static_score", "(p_partkey % 100) / 100 AS temporal_score", "p_size % 2 = 0 AS is_macro_or_sys", "p_size % 3 = 0 AS is_sub_component", "p_size % 5 = 0 AS is_internal", "false AS is_autopublished", "p_size % 7 = 0 AS is_deprecated", "CAST(NULL AS BOOLEAN) AS in_flagged_category", "false AS off_registry", "p_size % 11 = 0 AS is_yanked_or_squatted", "9e-1 AS former_glory")
    return rounded(scoring.combined_score(p).select("package", "score"), "score")


@query("s5_dependency_freshness", "SELECT depender AS package, round(exp(sum(ln(2e-1 + 8e-1 * CASE WHEN kind = 0 THEN 1e0 WHEN optional THEN 8e-1 + 2e-1 * (package % 10) / 10 ELSE (package % 10) / 10 END))), 6) AS dep_freshness FROM uses WHERE kind < 2 GROUP BY depender")
def _(v: Views):
    d = v.uses.where("kind < 2").selectExpr("depender AS package", "kind = 0 AS matches_latest", "optional", "(package % 10) / 10 AS popularity")
    return rounded(scoring.dependency_freshness(d), "dep_freshness")


@query("s5_cleaned_downloads", """WITH t AS (SELECT package, sum(n) AS downloads FROM daily GROUP BY package), l AS (SELECT u.package, max(t.downloads) AS theirs FROM uses u JOIN t ON t.package = depender GROUP BY u.package)
SELECT p.package, greatest(0e0, coalesce(t.downloads, 0) - 5e-1 * coalesce(theirs, 0)) AS cleaned_downloads FROM packages p LEFT JOIN t ON t.package = p.package LEFT JOIN l ON l.package = p.package""")
def _(v: Views):
    return scoring.cleaned_downloads(v.daily, v.uses, v.packages)


@query("s6_pairwise_rank_check", "WITH pairs AS (SELECT DISTINCT l_partkey AS lower, l_suppkey AS higher FROM lineitem) SELECT count(*) AS n_pairs, count(*) FILTER (WHERE a.rank < b.rank) AS n_right FROM pairs JOIN packages a ON a.package = lower JOIN packages b ON b.package = higher")
def _(v: Views):
    pairs = v.lineitem.selectExpr("l_partkey AS lower", "l_suppkey AS higher").distinct()
    return scoring.pairwise_rank_check(v.packages.selectExpr("package", "rank AS score"), pairs)


@query("s7_package_warnings", """WITH f AS (SELECT p_partkey AS package, p_size, p_size = 50 AS is_flagged, p_size = 49 AS is_placeholder, p_size NOT IN (49, 50) AS plain, p_size % 10 = 0 OR p_size % 9 = 0 AS helper FROM part)
SELECT package, 'flagged' AS kind, 3 AS severity FROM f WHERE is_flagged UNION ALL SELECT package, 'reserved', 2 FROM f WHERE is_placeholder UNION ALL SELECT package, 'big', 1 FROM f WHERE plain AND p_size > 30 UNION ALL SELECT package, 'not_in_repo', 2 FROM f WHERE plain AND p_size % 4 > 1 AND p_size % 3 > 0
UNION ALL SELECT package, 'no_keywords', 1 FROM f WHERE plain AND NOT helper AND p_size % 5 = 0 UNION ALL SELECT package, 'docs_failed', 2 FROM f WHERE plain AND p_size % 6 = 0 UNION ALL SELECT package, 'old_edition', 1 FROM f WHERE plain AND ((p_size >= 56) OR (p_size >= 31 AND p_size % 2 = 0))""")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "p_size = 50 AS is_flagged", "p_size = 49 AS is_placeholder", "p_size * 330000 AS size", "'MIT' AS license", "p_size % 4 AS n_releases", "p_size % 3 = 0 AS found_in_repo", "p_size % 5 AS n_keywords", "1 AS n_categories", "p_size % 10 = 0 AS is_macro", "p_size % 9 = 0 AS is_internal", "false AS is_sys", "true AS has_links", "p_size AS min_compiler", "CASE WHEN p_size % 2 = 0 THEN 2015 ELSE 2018 END AS edition", "p_size % 6 > 0 AS docs_built", "0e0 AS outdated_share", "'1.0' AS requirement")
    return scoring.package_warnings(p, scoring.lint_rules())


@query("s8_stale_after", """WITH r AS (SELECT p_partkey AS package, p_partkey * 17 % 3000 AS age, p_size % 3 = 0 AS pre, p_size % 4 = 0 AS nightly, p_size % 5 = 0 AS newer, p_size % 2 = 0 AS st, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 8 END AS status FROM part),
l AS (SELECT package, age, CASE WHEN pre THEN least(366e0, CASE WHEN nightly THEN 62 ELSE 93 END * CASE WHEN NOT st THEN 3 ELSE 1 END * status / 3) ELSE least(2330e0, CASE WHEN nightly THEN 186 ELSE 1116 END * CASE WHEN newer THEN 2 ELSE 1 END * status / 3) END AS lim FROM r)
SELECT package, round(lim, 6) AS limit_days, round(CASE WHEN age > lim THEN least(3e0, age / lim) ELSE 0e0 END, 6) AS severity FROM l""")
def _(v: Views):
    r = v.part.selectExpr("p_partkey AS package", "p_partkey * 17 % 3000 AS age_days", "p_size % 3 = 0 AS is_pre", "p_size % 4 = 0 AS is_nightly", "p_size % 5 = 0 AS newer_pre", "p_size % 2 = 0 AS has_stable", "CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 8 END AS status")
    return rounded(scoring.stale_after(r), "limit_days", "severity")


@query("b3_repository_urls", r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:www\.)?([^/]+)', 1)) AS domain, regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '(/index\.html|/)?(#.*)?$', '') AS comparable FROM pages")
def _(v: Views):
    return v.pages.select("page_id", clean.url_domain(F.col("url")).alias("domain"), clean.comparable_url(F.col("url")).alias("comparable"))


@query("b32_readme_props", r"SELECT page_id, len(regexp_extract_all(html, '(?i)<img\b')) AS n_images, len(regexp_extract_all(html, '(?i)<pre\b')) AS n_pre, len(regexp_extract_all(html, '(?i)<h[1-6]\b')) AS n_sections, len(regexp_extract_all(html, '(?i)<(?:li|tr)\b')) AS n_rows FROM pages")
def _(v: Views):
    return clean.readme_props(v.pages, "page_id", "html").select("page_id", "n_images", "n_pre", "n_sections", "n_rows")


@query("j4_license_report", """WITH p AS (SELECT p_partkey AS package, p_size % 4 AS l FROM part), u AS (SELECT DISTINCT depender AS package, package AS dep FROM uses), v AS (SELECT package, CASE l WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 0 END AS vir FROM p)
SELECT u.package, max(vir) AS virality FROM u JOIN v ON v.package = u.dep GROUP BY u.package""")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS dep", "CASE p_size % 4 WHEN 0 THEN 'MIT OR GPL-3.0' WHEN 1 THEN 'MIT AND GPL-3.0' WHEN 2 THEN 'Apache-2.0/MIT AND LGPL-2.1' ELSE 'Unknown-1.0' END AS license")
    closure = v.uses.selectExpr("depender AS package", "package AS dep").distinct()
    return clean.license_report(closure, p)


@query("j5_clean_people", "SELECT c_custkey AS id, concat('u', c_custkey, '@x.org') AS mail_key, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat('login', c_custkey) ELSE concat('u', c_custkey) END AS display_name FROM customer")
def _(v: Views):
    p = v.customer.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE ' ' END AS profile_name", "CASE WHEN c_custkey % 3 = 1 THEN concat('login', c_custkey) END AS login", "concat('u', c_custkey, '+news@x.org') AS email")
    return clean.clean_people(p)
