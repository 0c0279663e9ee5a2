"""Keywords, sentences and search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import settled
from .joins import top_n

# The stop words of phrase extraction.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "which", "with")


def gather_keywords(sources: DataFrame) -> DataFrame:
    """One bag per package from (package, keyword, weight, visible) of all sources: the largest weight, visible if any is."""
    k = sources.withColumn("keyword", F.lower(F.trim("keyword"))).where("keyword != ''")
    return k.groupBy("package", "keyword").agg(F.max("weight").alias("weight"), F.bool_or("visible").alias("visible"))


def source_weight(kind: str, place: Column) -> Column:
    """The weight of the keyword at ``place`` of a source."""
    return {"declared": 100 / (6 + 2 * place), "name": 100 / (8 + 2 * place), "auto": 150 / (80 + place) / 100, "author": 50 / (100 + place)}[kind]


def add_synonyms(bag: DataFrame, synonyms: DataFrame, hops: int = 2) -> DataFrame:
    """Synonyms (find, replace, relevance) of a bag's keywords at weight times min(relevance, .8), only where absent."""
    syn = synonyms.select(F.col("find").alias("keyword"), F.col("replace").alias("new"), F.least("relevance", F.lit(0.8)).alias("r"))
    front, out = bag.select("package", "keyword", "weight"), bag
    for _ in range(hops):
        front = front.join(syn, "keyword").groupBy("package", F.col("new").alias("keyword")).agg(F.max(F.col("weight") * F.col("r")).alias("weight"))
        front = front.join(out.select("package", "keyword"), ["package", "keyword"], "left_anti")
        out = out.unionByName(front.withColumn("visible", F.lit(False)))
    return out


def conditional_stopwords(bag: DataFrame, rules: DataFrame) -> DataFrame:
    """Where a rule's keyword is in a bag, its listed words lose two thirds; a rule without words halves all others.

    ``rules``: keyword, word (null for all others).
    """
    hit = bag.select("package", "keyword").join(rules, "keyword")
    listed = hit.where("word IS NOT NULL").groupBy("package", F.col("word").alias("keyword")).agg(F.count("*").alias("thirds"))
    every = hit.where("word IS NULL").groupBy("package").agg(F.count("*").alias("halves"), F.collect_set("keyword").alias("own"))  # a package's own keywords at most
    out = bag.join(listed, ["package", "keyword"], "left").join(every, "package", "left")
    halves = F.coalesce(F.col("halves") - F.coalesce(F.array_contains("own", F.col("keyword")).cast("int"), F.lit(0)), F.lit(0))
    return out.select("package", "keyword", (F.col("weight") / F.pow(F.lit(3.0), F.coalesce("thirds", F.lit(0))) / F.pow(F.lit(2.0), halves)).alias("weight"), "visible")


def auto_keywords(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 25, longest: int = 3) -> DataFrame:
    """T4: phrases between stop words and punctuation, scored by their words' degree over frequency; the best ``n`` per text.

    ``key`` names a text. Texts are exchanged once, whole, by it; phrases and words are counted where their text is. The
    number of tasks is given, as Spark would join tasks by the size of the texts, and their words take ten times as much.
    """
    chunks = F.split(F.lower(text), rf"\b(?:{'|'.join(STOP_WORDS)})\b|[^\p{{L}}\p{{N}}\s-]+|\n")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(key, text).where(F.col(key).isNotNull()).repartition(tasks, key)
    # up to ``longest`` words, the first of three letters at least; a split by this white space would compile its pattern for every chunk
    short = rf"\A\S{{3,}}+(?:\s++\S*+){{0,{longest - 1}}}+\z"
    phrases = placed.select(key, F.explode(chunks).alias("p")).select(key, F.trim("p").alias("p")).where(F.col("p").rlike(short))
    counted = phrases.select(key, F.regexp_replace("p", r"\s+", " ").alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("n"))
    words = counted.withColumn("words", F.split("phrase", " ")).select(key, "phrase", "n", F.size("words").alias("size"), F.explode("words").alias("word"))
    of_word = Window.partitionBy(key, "word")
    rated = words.withColumn("ratio", F.sum(F.col("n") * F.col("size")).over(of_word) / F.sum("n").over(of_word))
    scored = rated.groupBy(key, "phrase").agg(F.round(F.sum("ratio"), 6).alias("score"), F.max("n").alias("n"))
    return top_n(scored, [key], [F.desc("n"), F.desc("score"), F.col("phrase")], n)


def section_phrases(sections: DataFrame, budget: int = 300) -> DataFrame:
    """T5: the first ``budget`` characters of a package's sections, the most telling titles first."""
    t = F.lower("title")
    relevance = F.when(t.rlike("about|what|overview|introduction"), 1.0).when(t == "", 0.6).when(t.rlike("feature|usage|example"), 0.5).when(t.rlike("install|getting started"), 0.3).when(t.rlike("licen[cs]e|contribut|changelog"), 0.1).otherwise(0.4)
    w = Window.partitionBy("package").orderBy(F.desc("relevance"), "place")
    s = sections.withColumns({"relevance": relevance, "text": F.trim(F.regexp_replace("text", r"(?i)https?://\S+|\s+", " "))})
    s = s.withColumn("used", F.sum(F.length("text")).over(w) - F.length("text")).where(F.col("used") < budget)
    return s.select("package", "place", "relevance", F.substring(F.col("text"), F.lit(1), (budget - F.col("used")).cast("int")).alias("text"))


def normalise_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 16) -> DataFrame:
    """Sentences with digits replaced by ``_``, lower-cased, of more than ``least`` characters."""
    s = docs.select(key, F.posexplode(F.split(text, r"[.!?\n]+")).alias("place", "s"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower("s"), "[0-9]+", "_"), r"\s+", " "))
    return s.select(key, "place", clean.alias("sentence")).where(F.length("sentence") > least)


PIECE = 1_000_000  # letters of a batch of sentences


def folded_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", variables: str | None = None, longer_than: int = 16) -> DataFrame:
    """T6 with a package's own names: sentences in a form that equals that of other packages' boilerplate.

    A line falls into fragments at ``[!?.;:]`` before a space. Digits and the row's ``variables`` (an array, whole words in
    any case) become ``_`` and A-Z lower case; short fragments are joined until the form has more than ``longer_than`` bytes
    or the line ends. Returns ``key``, place (from 0), sentence, original. Null texts have no sentences; null variables are
    skipped; every row folds its own text, in time proportional to it.
    """
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("_text"), (F.col(variables) if variables else F.array().cast("array<string>")).alias("_variables"))
    kind = rows.schema[key].dataType.simpleString()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def folded(body: str, names: list[str]) -> Iterator[tuple[str, str]]:
        own = re.compile("|".join([*(rf"\b{re.escape(n)}\b" for n in names if n), "[0-9]+"]), re.IGNORECASE)
        for line in filter(None, map(str.strip, body.split("\n"))):
            form, original = "", ""
            for fragment in re.split(r"[!?.;:] ", line):
                gap = " " if form else ""
                form, original = form + gap + own.sub("_", fragment).translate(lower), original + gap + fragment
                if len(form.encode()) > longer_than:
                    yield form, original
                    form, original = "", ""
            if form:
                yield form, original

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        letters, schema = 0, None
        flat = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)
        for batch in batches:
            schema = pa.schema([(key, batch.schema.field(0).type), ("place", pa.int32()), ("sentence", pa.string()), ("original", pa.string())])
            # texts become Python's one by one, and sentences leave by the megabyte
            for k, body, names in zip(*batch.columns, strict=True):
                for n, (form, original) in enumerate(folded(body.as_py(), names.as_py() or [])):
                    out.append((k.as_py(), n, form, original))
                    letters += len(form) + len(original)
                    if letters > PIECE:
                        yield flat()
                        out, letters = [], 0
        if out:
            yield flat()

    return rows.mapInArrow(run, f"`{key}` {kind}, place int, sentence string, original string")


def unique_text(sentences: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """A sentence stays with the document of the highest score, ties to the smallest key.

    A max over pairs is combined before the shuffle, so a sentence of all documents costs one row per task.
    """
    s = sentences.join(scores, key).select(key, "place", "sentence", "score", F.xxhash64("sentence").alias("h"))
    owner = s.groupBy("h").agg(F.min(F.struct((-F.col("score")).alias("o"), F.col(key).alias("owner"))).alias("b")).select("h", F.col("b.owner").alias("owner"))
    mine = s.join(owner, "h").where(F.col(key) == F.col("owner"))
    return mine.groupBy(key).agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.min("sentence").alias("first_sentence"))


def postings(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(field, term, key, tf) of all fields; words are lower-cased runs of letters and digits, lightly stemmed in the readme."""
    out = None
    for field, column in fields.items():
        words = docs.select(key, F.explode(F.split(F.lower(column), r"[^\p{L}\p{N}]+")).alias("term")).where("term != ''")
        if field == "readme":
            words = words.withColumn("term", F.regexp_replace("term", r"(?<=\w{3})(?:ing|ed|es|s)$", ""))
        part = words.groupBy("term", key).agg(F.count("*").alias("tf")).withColumn("field", F.lit(field))
        out = part if out is None else out.unionByName(part)
    return out


def search(index: DataFrame, docs: DataFrame, queries: DataFrame, key: str, limit: int, boosts: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """For a table of queries (query_id, text) the best documents by BM25 over boosted fields times the base score.

    Every word of a query must occur. ``docs``: key, name, base_score. An exact
    name match counts 1.1 times the best relevance.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term")).where("term != ''")
    need = words.groupBy("query_id").agg(F.count("*").alias("n_words"))
    sizes = index.groupBy("field", key).agg(F.sum("tf").alias("len"))
    means = sizes.groupBy("field").agg(F.avg("len").alias("mean"), F.count("*").alias("n_docs"))  # one row per field
    df = index.join(words.select("term").distinct(), "term", "left_semi")
    idf = df.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(x))) for f, x in boosts.items()], F.lit(0.0))
    hit = df.join(sizes, ["field", key]).join(F.broadcast(means), "field").join(idf, ["field", "term"])
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    per = hit.withColumn("w", weight * boost).groupBy("term", key).agg(F.sum("w").alias("w"))
    found = words.join(per, "term").groupBy("query_id", key).agg(F.sum("w").alias("relevance"), F.count("*").alias("n")).join(need, "query_id").where("n = n_words")
    scored = found.join(docs, key).join(queries.select("query_id", F.lower("text").alias("q")), "query_id")
    best = F.max("relevance").over(Window.partitionBy("query_id"))
    relevance = F.when(F.lower("name") == F.col("q"), 1.1 * best).otherwise(F.col("relevance"))
    return top_n(scored.withColumn("score", F.round(relevance * F.col("base_score"), 6)), ["query_id"], [F.desc("score"), F.col(key)], limit).select("query_id", key, "score", "pos")


# Keywords that say little.
GENERIC, LESS, RESERVED = ("api", "cli"), ("api", "cli", "rust"), "reserved"
DIVISIONS, LEAST_SETS = 10, 25


def _popular(sets: DataFrame, chosen: DataFrame, ignored: Column) -> DataFrame:
    """Per query the keyword that splits its keyword sets best, and how many sets no chosen keyword covers yet.

    ``chosen``: query_id, n_sets, taken (array), last. A chosen keyword leaves all sets; a set that held one weighs minus
    half. A keyword "q-x" or "x-q" of an uncovered set also counts, twice, for x. Values tie by the smaller keyword.
    """
    s = sets.join(chosen.select("query_id", "taken"), "query_id")
    weight = F.when(F.arrays_overlap("keywords", "taken"), F.expr("-(weight DIV 2)")).otherwise(F.col("weight"))
    s = s.select("query_id", "q", F.array_except("keywords", "taken").alias("left"), weight.alias("w"))
    # a row without a keyword counts the open sets
    s = s.select("*", F.explode(F.concat("left", F.array(F.lit(None).cast("string")))).alias("k"))
    k, before, behind = F.col("k"), F.concat("q", F.lit("-")), F.concat(F.lit("-"), "q")
    rest = F.when(F.startswith(k, before), F.substring(k, F.length(before) + 1, F.length(k))).when(F.endswith(k, behind), F.substring(k, F.lit(1), F.length(k) - F.length(behind)))
    s = s.withColumn("rest", F.when(F.col("w") > 0, rest))
    one = lambda k, w: F.struct(k.alias("keyword"), w.cast("bigint").alias("w"))
    own = one(k, F.when(k.isNull(), (F.col("w") > 0).cast("bigint")).otherwise(F.col("w")))
    votes = F.when(F.col("rest").isNotNull() & ~F.array_contains("left", F.col("rest")), F.array(own, one(F.col("rest"), 2 * F.col("w")))).otherwise(F.array(own))
    counts = s.select("query_id", F.inline(votes)).groupBy("query_id", "keyword").agg(F.count("*").alias("pop"), F.sum("w").alias("w")).join(chosen, "query_id")
    weight = F.when(F.col("keyword").isin(*LESS), F.expr("w * 3 DIV 4")).otherwise(F.col("w"))
    value = weight * F.when((F.col("pop") >= 10) & (F.col("pop") <= F.expr("n_sets DIV 3")), 2).otherwise(1)
    fit = F.col("keyword").isNotNull() & (F.col("pop") > 2) & (F.col("pop") <= F.expr("n_sets * 3 DIV 4")) & ~ignored
    best = F.min(F.when(fit, F.struct((-value).alias("v"), "keyword")))["keyword"]
    return counts.groupBy("query_id", "n_sets", "taken", "last").agg(best.alias("next"), F.max(F.when(F.col("keyword").isNull(), F.col("w"))).alias("open"))


def _bags(keywords: DataFrame) -> DataFrame:
    """A document's keywords as one sorted array: doc_id, all."""
    return keywords.where("keyword IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set("keyword")).alias("all"))


def dividing_keywords(results: DataFrame, keywords: DataFrame, queries: DataFrame, limit: int, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Per query up to ten keywords that divide its results, found one after another.

    ``results``: query_id, doc_id, pos, score; ``keywords``: doc_id, keyword; ``queries``: query_id, text, query_keywords
    (array, left out of all sets). Results with the same keywords count once, those with a ``skipped`` keyword not at all;
    queries with fewer than 25 sets have no answer. The most common keyword may be a synonym of the query, so the first
    taken is the best beside it. Rounds run over all queries at once and end for a query when fewer than 25 sets are not
    covered, no keyword is left or one returns.

    Results carry the number of their set, the smallest document that has it; keywords are only put to the distinct sets
    of a query, and what a round asks for is a row a query.
    """
    none = F.array().cast("array<string>")
    bags = settled(_bags(keywords))
    classes = settled(bags.groupBy("all").agg(F.min("doc_id").alias("bag")))
    numbered = results.join(bags.join(classes, "all").select("doc_id", "bag"), "doc_id", "left")
    once = numbered.groupBy("query_id", "bag").agg(F.min("pos").alias("pos"), F.min_by("score", "pos").alias("score"))
    asked = settled(queries.select("query_id", F.regexp_replace(F.lower("text"), "[ _]+", "-").alias("q"), F.coalesce("query_keywords", none).alias("own")))
    weight = F.when(F.col("pos") <= limit, 2048).otherwise(1024) + (128 * F.col("score")).cast("int")
    sets = once.join(classes, "bag", "left").join(asked, "query_id").select("query_id", "q", F.array_except(F.coalesce("all", none), "own").alias("keywords"), weight.cast("bigint").alias("weight"))
    sets = settled(sets.where(~F.arrays_overlap("keywords", F.array(*map(F.lit, skipped)).cast("array<string>"))))
    sizes = sets.groupBy("query_id").agg(F.count("*").alias("n_sets")).where(F.col("n_sets") >= LEAST_SETS)
    start = settled(sizes.select("query_id", "n_sets", none.alias("taken"), F.lit(None).cast("string").alias("last")))
    common = settled(_popular(sets, start, F.col("keyword").isin(*GENERIC)).where("next IS NOT NULL").select("query_id", "n_sets", "taken", F.col("next").alias("last")))
    now = settled(_popular(sets, common, F.col("keyword") == F.col("last")).where("next IS NOT NULL").select("query_id", "n_sets", F.array("next").alias("taken"), F.col("next").alias("last")))
    found = now
    for _ in range(DIVISIONS - 1):
        onward = _popular(sets, now, F.col("keyword").isin(RESERVED) | (F.col("keyword") == F.col("last")))
        onward = onward.where((F.col("open") >= LEAST_SETS) & F.col("next").isNotNull() & ~F.array_contains("taken", F.col("next")))
        now = settled(onward.select("query_id", "n_sets", F.concat("taken", F.array("next")).alias("taken"), F.col("next").alias("last")))
        if now.isEmpty():
            break
        found = found.unionByName(now)
    return found.select("query_id", F.col("last").alias("keyword"), F.size("taken").alias("pos"))


def promote_representatives(results: DataFrame, dividing: DataFrame, keywords: DataFrame, n: int = 6) -> DataFrame:
    """The top three (of more than three) and the first hit of each of ``n`` dividing keywords come first, with no lower score than what follows."""
    taken = settled(dividing.where(F.col("pos") <= n).groupBy("query_id").agg(F.collect_set("keyword").alias("taken")))  # n at most
    shared = results.join(_bags(keywords), "doc_id").select("query_id", "doc_id", "pos", "all").join(taken, "query_id").select("query_id", "doc_id", "pos", F.explode(F.array_intersect("all", "taken")).alias("keyword"))
    first = shared.groupBy("query_id", "keyword").agg(F.min_by("doc_id", "pos").alias("doc_id")).select("query_id", "doc_id").distinct().withColumn("promoted", F.lit(True))
    first = settled(first)  # n rows a query
    per = Window.partitionBy("query_id")
    r = results.join(first, ["query_id", "doc_id"], "left").withColumn("front", ((F.col("pos") <= 3) & (F.count("*").over(per) > 3)) | F.coalesce("promoted", F.lit(False)))
    follows = F.max(F.when(~F.col("front"), F.col("score"))).over(per)
    return r.select("query_id", "doc_id", "front", F.row_number().over(per.orderBy(F.desc("front"), "pos")).alias("new_pos"), F.when(F.col("front"), F.greatest("score", follows)).otherwise(F.col("score")).alias("score"))


def _suggested(dividing: DataFrame, queries: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("query_id"))
    return dividing.withColumn("n", n).join(queries.select("query_id", F.trim("text").alias("q")), "query_id").withColumn("search", F.concat_ws(" ", "q", "keyword"))


def search_also(dividing: DataFrame, queries: DataFrame) -> DataFrame:
    """The query with each dividing keyword, if there are three or more."""
    return _suggested(dividing, queries).where("n >= 3").select("query_id", "keyword", "search", "pos")


def did_you_mean(dividing: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` dividing keywords that are not the query with a prefix or suffix; only if there are three and two more for each word of the query."""
    words = F.size(F.split("q", " "))
    fine = _suggested(dividing, queries).where((F.col("n") >= 3 + 2 * words) & ~F.startswith("keyword", F.concat("q", F.lit("-"))) & ~F.endswith("keyword", F.concat(F.lit("-"), "q")))
    return top_n(fine, ["query_id"], [F.col("pos")], n, "place").select("query_id", "keyword", "search", "place")


def synonym_candidates(keywords: DataFrame, least: int = 2) -> DataFrame:
    """Keywords equal but for dashes or a plural s; the more frequent one is the replacement."""
    n = keywords.groupBy("keyword").agg(F.count("*").alias("n")).withColumn("key", F.regexp_replace(F.regexp_replace("keyword", "[-_ ]", ""), "s$", ""))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "keyword")
    best = n.withColumn("best", F.first("keyword").over(w)).withColumn("best_n", F.first("n").over(w))
    return best.where((F.col("keyword") != F.col("best")) & (F.col("best_n") >= least)).select(F.col("keyword").alias("find"), F.col("best").alias("replace"), F.col("n").alias("votes"))


# What each of the four steps of keyword_splits leaves out of sets, and whose results it leaves out.
SPLIT_WORDS = (("rust", "api", "client", "macro", "proc-macro", "no-std", "cargo"), ("no-std", "cli", "rust", "client", "wasm"), ("api", "cli", "macro", "macros", "rust"), ("client", "api"))
SPLIT_RESULTS = (("blockchain", "ethereum", "bitcoin", "cryptocurrency", "solana"), ("blockchain", "cryptocurrency"), (), ())
SPLIT_ROUNDS, LEAST_LEFT = 5, 50


def related_keywords(keywords: DataFrame, ranks: DataFrame, asked: DataFrame, rounds: int = SPLIT_ROUNDS, n: int = 300) -> DataFrame:
    """Per asked keyword the most common other one of its results, and up to ``rounds`` more, each the most common of the sets that hold none before it.

    ``keywords``: doc_id, keyword; ``ranks``: doc_id, rank; ``asked``: find, without, words, bad (arrays): results are the
    ``n`` best documents with ``find`` and none of ``without``, 25 at least; those with a ``bad`` keyword and equal sets are
    left out, ``words`` belong to no set. A round needs 50 sets. Returns find, keyword, pos (0 for the first).
    """
    return _related(_bags_by_rank(keywords, ranks), asked, rounds, n)


def _bags_by_rank(keywords: DataFrame, ranks: DataFrame) -> DataFrame:
    return settled(_bags(keywords).join(ranks.select("doc_id", "rank"), "doc_id"))


def _related(docs: DataFrame, asked: DataFrame, rounds: int, n: int = 300) -> DataFrame:
    """``related_keywords`` over ``docs``: doc_id, all, rank. Only places are sorted; a hit gets its keywords back once it is among the best."""
    asked = settled(asked)
    hits = docs.select("doc_id", "rank", "all", F.explode("all").alias("find")).join(asked.select("find", "without"), "find").where(~F.arrays_overlap("all", "without")).select("find", "doc_id", "rank")
    best = settled(top_n(hits, ["find"], [F.desc("rank"), F.col("doc_id")], n).select("find", "doc_id"))
    enough = best.groupBy("find").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SETS).select("find")
    kept = best.join(enough, "find").join(docs.select("doc_id", "all"), "doc_id").join(asked, "find")
    sets = settled(kept.where(~F.arrays_overlap("all", "bad")).select("find", F.array_except("all", "words").alias("keywords")).distinct())

    def common(left: DataFrame, least: int) -> DataFrame:
        votes = left.select("find", F.explode(F.concat("keywords", F.array(F.lit(None).cast("string")))).alias("keyword")).groupBy("find", "keyword").agg(F.count("*").alias("n"))
        one = votes.groupBy("find").agg(F.min(F.when(F.col("keyword").isNotNull(), F.struct((-F.col("n")).alias("n"), "keyword")))["keyword"].alias("keyword"), F.max(F.when(F.col("keyword").isNull(), F.col("n"))).alias("left"))
        return settled(one.where((F.col("left") >= least) & F.col("keyword").isNotNull()).select("find", "keyword"))

    last = common(sets, 0)
    found, left = last.withColumn("pos", F.lit(0)), sets
    for i in range(1, rounds + 1):
        left = left.join(last.withColumnRenamed("keyword", "taken"), "find").where(~F.array_contains("keywords", F.col("taken"))).drop("taken")
        last = common(left, LEAST_LEFT)
        found = found.unionByName(last.withColumn("pos", F.lit(i)))
        if last.isEmpty():
            break
    return found


def keyword_splits(keywords: DataFrame, ranks: DataFrame, asked: DataFrame) -> DataFrame:
    """The keywords that split the results of ``find`` into groups: the most related one, then the most common beside it, beside that, and beside both; the last may be missing."""
    texts = lambda *parts: F.array(*[F.lit(x) if isinstance(x, str) else x for x in parts]).cast("array<string>")
    docs = _bags_by_rank(keywords, ranks)
    now, names = asked.select("find"), []
    for step, (name, without, words, bad) in enumerate((("related", (), (), ()), ("first", ("related",), (), ("related",)), ("second", ("first",), ("related",), ("first",)), ("third", ("first", "second"), ("related",), ("first", "second")))):
        known = now.where(F.col(names[-1]).isNotNull()) if names else now
        column = lambda *c: [F.col(x) for x in c]
        ask = known.select("find", texts(*column(*without)).alias("without"), texts(F.col("find"), *column(*words), *SPLIT_WORDS[step]).alias("words"), texts(*column(*bad), *SPLIT_RESULTS[step]).alias("bad"))
        best = _related(docs, ask, rounds=0).select("find", F.col("keyword").alias(name))
        now = settled(now.join(best, "find", "left"))
        names.append(name)
    return now.where("second IS NOT NULL")


def keyword_page(keywords: DataFrame, packages: DataFrame, n: int = 250) -> DataFrame:
    """Per keyword its packages by base score."""
    return top_n(keywords.select("keyword", "package").distinct().join(packages.select("package", "rank"), "package"), ["keyword"], [F.desc("rank"), F.col("package")], n).select("keyword", "package", "pos")


def normalise_query(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Every word of a query in keyword form, replaced by its synonym where it has one."""
    words = queries.select("query_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("place", "word")).withColumn("find", F.regexp_replace(F.lower("word"), "_", "-"))
    best = synonyms.groupBy("find").agg(F.max_by("replace", F.struct("relevance", "replace")).alias("replace"))
    new = words.join(best, "find", "left").withColumn("w", F.coalesce("replace", "find"))
    return new.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "w"))), lambda s: s["w"]), " ").alias("text"))  # a query's words
