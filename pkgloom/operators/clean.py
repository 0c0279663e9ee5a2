"""Cleaning jobs over packages, people and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence families and how far they spread.
VIRALITY = (("AGPL", 6), ("LGPL", 2), ("GPL", 5), ("CC-", 4), ("GFDL", 1), ("MIT", 0), ("Apache", 0), ("BSD", 0), ("ISC", 0), ("Zlib", 0), ("FTL", 0), ("MPL", 0), ("IJG", 0), ("CC0", 0))


def url_domain(url: Column) -> Column:
    """The host without www.; pages hosts become one, raw content has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]+)", 1))
    return F.when(host.endswith(".github.io"), "github.io").when(host.endswith(".githubusercontent.com"), None).when(host != "", host)


def comparable_url(url: Column) -> Column:
    """What two addresses are compared by: no scheme, fragment, index page, last slash or case."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://", ""), r"(/index\.html|/)?(#.*)?$", "")


def same_url(a: Column, b: Column) -> Column:
    return comparable_url(a) == comparable_url(b)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` takes it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_repo(url: Column) -> Column:
    """(host, owner, repo, path) of a hosted repository, lower-cased, without .git; null if it is none."""

    def hosted(parts: Column) -> Column:
        host = parts[0]
        stop = F.array_min(F.array_compact(F.transform(F.array(F.lit("-"), F.lit("tree"), F.lit("blob"), F.lit("graphs")), lambda w: F.nullif(F.array_position(parts, w), F.lit(0)))))
        last = F.when(host.contains("gitlab"), F.coalesce(stop - 1, F.size(parts))).otherwise(3).cast("int")
        name = F.regexp_replace(F.array_join(F.slice(parts, 3, F.greatest(last - 2, F.lit(1))), "/"), r"\.git$", "")
        ok = (F.size(parts) >= 3) & host.rlike(r"^(github|gitlab|bitbucket)\.")
        return F.when(ok, _once(name, lambda n: F.when(n != "", F.struct(host.alias("host"), parts[1].alias("owner"), n.alias("repo")))))

    clean = F.regexp_replace(F.lower(url), r"^(?:git\+)?[a-z]+://(?:www\.)?", "")
    return _once(F.split(F.regexp_replace(clean, r"(\.git)?/?([#?].*)?$", ""), "/"), hosted)


def repo_urls(repo: Column, directory: Column | None = None, revision: Column | None = None) -> Column:
    """Addresses to clone and browse a repository, bases of its readme's links and images, and its contributors.

    ``directory`` has no slash at its begin (none: the root), ``revision`` is HEAD where there is none.
    """
    return _once(repo, lambda r: _urls(r, directory, revision))


def _urls(repo: Column, directory: Column | None, revision: Column | None) -> Column:
    folder = F.lit("") if directory is None else F.coalesce(directory, F.lit(""))
    at = F.lit("HEAD") if revision is None else F.coalesce(revision, F.lit("HEAD"))
    path = F.concat(repo["owner"], F.lit("/"), repo["repo"])
    base = F.concat(F.lit("https://"), repo["host"], F.lit("/"), path)
    gitlab, bitbucket = repo["host"].startswith("gitlab."), repo["host"].startswith("bitbucket.")
    web = F.concat(base, F.when(gitlab & repo["repo"].contains("/"), "/-").otherwise(""))  # nested groups
    below = F.concat(F.lit("/"), at, F.lit("/"), folder, F.when((folder != "") & ~folder.endswith("/"), "/").otherwise(""))
    view = F.when((folder != "") | (at != "HEAD"), F.concat(F.when(bitbucket, "/src/").otherwise("/tree/"), at, F.lit("/"), folder)).otherwise("")
    return F.when(
        repo.isNotNull(),
        F.struct(
            F.concat(base, F.when(bitbucket, "").otherwise(".git")).alias("git"),
            F.concat(web, view).alias("http"),
            F.concat(web, F.when(bitbucket, "/src").otherwise("/blob"), below).alias("readme_base"),
            F.when(gitlab | bitbucket, F.concat(web, F.lit("/raw"), below)).otherwise(F.concat(F.lit("https://raw.githubusercontent.com/"), path, below)).alias("image_base"),
            F.when(gitlab, F.concat(web, F.lit("/graphs/master"))).when(bitbucket, F.concat(base, F.lit("/commits/all"))).otherwise(F.concat(base, F.lit("/graphs/contributors"))).alias("contributors"),
        ),
    )


def parse_origin(c: Column) -> Column:
    """B1: (host, package, repo owner, repo) of ``host:name`` or ``host:owner/repo/package``."""
    host, rest = F.split_part(c, F.lit(":"), F.lit(1)), F.regexp_replace(c, "^[^:]*:", "")
    parts = F.split(rest, "/", 3)
    hosted = F.size(parts) == 3
    return F.when(c.contains(":"), F.struct(host.alias("host"), F.when(hosted, parts[2]).otherwise(F.lower(rest)).alias("package"), F.when(hosted, parts[0]).alias("owner"), F.when(hosted, parts[1]).alias("repo")))


def format_origin(s: Column) -> Column:
    return F.when(s["owner"].isNotNull(), F.concat(s["host"], F.lit(":"), s["owner"], F.lit("/"), s["repo"], F.lit("/"), s["package"])).otherwise(F.concat(s["host"], F.lit(":"), s["package"]))


def normalize_keyword(c: Column) -> Column:
    """Lower case; ASCII ones in kebab case, but for names that begin like iOS."""
    spelled = F.when(c.rlike("^(eBPF|iOS|LaTeX|iP|iM)"), F.lower(c)).otherwise(c)
    cut = F.regexp_replace(spelled, "(?<=[a-z][0-9]{0,9})(?=[A-Z])|(?<=[A-Z][0-9]{0,9})(?=[A-Z][a-z])", "-")
    kebab = F.lower(F.regexp_replace(F.regexp_replace(cut, "[^A-Za-z0-9]+", "-"), "^-|-$", ""))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.lower(c)).otherwise(kebab)


def license_virality(c: Column) -> Column:
    """The largest over AND of the smallest over OR or slash; unknown licences are ignored."""

    def one(name: Column) -> Column:
        out = F.lit(None).cast("int")
        for prefix, n in reversed(VIRALITY):
            out = F.when(name.startswith(prefix), n).otherwise(out)
        return out

    either = lambda part: F.array_min(F.array_compact(F.transform(F.split(part, r"\s+OR\s+|\s*/\s*"), lambda x: one(F.trim(F.regexp_replace(x, r"[()]", ""))))))
    return F.array_max(F.array_compact(F.transform(F.split(c, r"\s+AND\s+"), either)))


def release_train(ts: Column) -> Column:
    """Compiler trains leave every six weeks since 2015-05-15."""
    n = F.floor((F.floor(F.datediff(ts, F.lit("2015-05-15").cast("date")) / 7) + 1) / 6)
    return F.when(n >= 0, n.cast("int"))


def readme_props(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Counts over a page's markup; badges are no images."""
    h = F.col(html)
    n = lambda pattern: F.size(F.regexp_extract_all(h, F.lit(pattern), F.lit(0)))
    code = F.aggregate(F.regexp_extract_all(h, F.lit(r"(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(F.regexp_replace(x, "<[^>]*>", "")))
    plain = F.length(F.trim(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style|pre)\b.*?</\1>", " "), "<[^>]*>", " ")))
    return pages.select(key, n(r"(?i)<img\b(?![^>]*(?:badge|shields\.io))").alias("n_images"), n(r"(?i)<pre\b").alias("n_pre"), n(r"(?i)<h[1-6]\b").alias("n_sections"), n(r"(?i)<(?:li|tr)\b").alias("n_rows"), code.alias("code_len"), plain.alias("text_len"))


def license_report(closure: DataFrame, licenses: DataFrame) -> DataFrame:
    """The strongest licence in each package's closure (0 if none is known)."""
    lic = licenses.select("dep", license_virality(F.col("license")).alias("v"))
    return closure.join(lic, "dep").groupBy("package").agg(F.coalesce(F.max("v"), F.lit(0)).alias("virality"))


def clean_people(people: DataFrame) -> DataFrame:
    """The address to compare by (no +tag) and the first usable name."""
    used = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    local = F.regexp_extract("email", r"^([^@+]*)", 1)
    return people.select("id", F.regexp_replace("email", r"\+[^@]*@", "@").alias("mail_key"), F.coalesce(used("profile_name"), used("login"), F.nullif(local, F.lit(""))).alias("display_name"))


# Extensions and comment marks of languages that count as code (line, open, close, nested)
LANGUAGES = {
    "Rust": (["rs"], "//", "/*", "*/", True), "C": (["c"], "//", "/*", "*/", False), "C++": (["cc", "cpp", "cxx"], "//", "/*", "*/", False), "C#": (["cs"], "//", "/*", "*/", False),
    "Go": (["go"], "//", "/*", "*/", False), "Java": (["java"], "//", "/*", "*/", False), "JavaScript": (["js", "mjs", "cjs"], "//", "/*", "*/", False), "TypeScript": (["ts"], "//", "/*", "*/", False),
    "Kotlin": (["kt", "kts"], "//", "/*", "*/", True), "Scala": (["scala"], "//", "/*", "*/", True), "Swift": (["swift"], "//", "/*", "*/", True), "Zig": (["zig"], "//", "", "", False),
    "Python": (["py", "pyw"], "#", '"""', '"""', False), "Bash": (["bash"], "#", "", "", False), "Shell": (["sh"], "#", "", "", False), "Ruby": (["rb"], "#", "=begin", "=end", False), "Perl": (["pl", "pm"], "#", "=pod", "=cut", False),
    "R": (["r"], "#", "", "", False), "Lua": (["lua"], "--", "--[[", "]]", False), "Haskell": (["hs"], "--", "{-", "-}", True), "SQL": (["sql"], "--", "/*", "*/", False), "Assembly": (["asm", "s"], ";", "", "", False),
}


def code_stats(files: DataFrame) -> DataFrame:
    """Code and comment lines per package and language by extension.

    ``files``: package, path, content. The top folders tests, benches, docs and
    examples, files that begin with a dot, and languages that are no code are left
    out. A file's lines are folded in order with the depth of open block comments
    as state: a line is a comment if it begins in or with a comment and holds
    nothing after its last end; string literals open no comments. Empty lines
    count as neither; null content has no lines.
    """
    marks = F.create_map(*[x for name, (ends, *m) in LANGUAGES.items() for e in ends for x in (F.lit(e), F.struct(F.lit(name).alias("language"), *[F.lit(v).alias(n) for n, v in zip(("line", "open", "close", "nested"), m, strict=True)]))])
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    skipped = F.col("path").rlike(r"^(tests|benches|examples|docs)/|(^|/)\.[^/]*$")
    found = files.where(~skipped).select("package", F.try_element_at(marks, ext).alias("mark"), "content").where("mark IS NOT NULL")
    line, start, end = F.col("mark.line"), F.col("mark.open"), F.col("mark.close")
    blocks, same = start != "", start == end
    at = lambda mark, t: F.call_function("locate", mark, t)
    count = lambda t, mark: F.when(blocks, F.floor((F.length(t) - F.length(F.replace(t, mark, F.lit("")))) / F.length(mark))).otherwise(0).cast("int")
    after = lambda t: F.when(blocks, F.trim(F.call_function("substring_index", t, end, F.lit(-1)))).otherwise(t)

    def bare(t: Column) -> Column:  # outside of a comment: without string literals, then without a line comment that no block comment opened before
        plain = F.when(same, t).otherwise(F.regexp_replace(t, r'"(?:\\.|[^"\\])*"', '""'))
        cut = F.call_function("substring_index", plain, line, F.lit(1))
        return F.when(blocks & (at(start, plain) > 0) & ((at(line, plain) == 0) | (at(start, plain) <= at(line, plain))), plain).otherwise(cut)

    facts = lambda t: F.struct(count(t, start).alias("opens"), count(t, end).alias("closes"), after(t).alias("tail"), (blocks & (at(start, after(t)) > 0)).alias("reopens"))
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda t: t != "")
    lines = F.transform(lines, lambda t: F.struct(t.alias("t"), bare(t).alias("bare")))
    lines = F.transform(lines, lambda x: F.struct(
        (x["t"].startswith(line) & ~(blocks & x["t"].startswith(start) & (F.length(start) > F.length(line)))).alias("remark"), (blocks & x["t"].startswith(start)).alias("begins"), facts(x["bare"]).alias("outside"), facts(x["t"]).alias("inside"),
    ))

    def step(state: Column, x: Column) -> Column:
        within = state["depth"] > 0
        quiet = ~within & x["remark"]
        f = lambda name: F.when(within, x["inside"][name]).otherwise(x["outside"][name])
        single = F.when(f("closes") > 0, f("reopens").cast("int")).otherwise((within | (f("opens") > 0)).cast("int"))
        depth = F.when(quiet | ~blocks, state["depth"]).when(same, F.pmod(state["depth"] + f("opens"), F.lit(2))).when(F.col("mark.nested"), F.greatest(F.lit(0), state["depth"] + f("opens") - f("closes"))).otherwise(single)
        ended = (f("tail") == "") | f("tail").startswith(line)
        comment = quiet | ((within | x["begins"]) & ((f("closes") == 0) | ended | (depth > 0)))
        return F.struct(depth.cast("int").alias("depth"), (state["code"] + (~comment).cast("int")).alias("code"), (state["comments"] + comment.cast("int")).alias("comments"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("code"), F.lit(0).alias("comments"))
    per_file = found.select("package", F.col("mark.language").alias("language"), F.aggregate(F.coalesce(lines, F.array().cast("array<struct<remark:boolean, begins:boolean, outside:struct<opens:int, closes:int, tail:string, reopens:boolean>, inside:struct<opens:int, closes:int, tail:string, reopens:boolean>>>")), zero, step).alias("n"))
    return per_file.groupBy("package", "language").agg(F.sum("n.code").alias("code"), F.sum("n.comments").alias("comments")).where("code + comments > 0")


def source_flags(files: DataFrame) -> DataFrame:
    """Of a package's Rust sources: unstable features in the first 1000 lines of a root file, the old try in any, and the root's documentation.

    Documentation are the lines begun by ``//!`` and blocks begun by ``/*!`` that end on a later line.
    """
    rust = files.where(F.col("path").endswith(".rs"))
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    cut = lambda t, mark: F.substring_index(t, mark, 1)
    root = F.col("path").rlike(r"^src/(lib|main)\.rs$|^lib\.rs$")
    unstable = root & F.exists(F.slice(lines, 1, 1000), lambda t: cut(cut(t, '"'), "//").contains("#![feature("))
    old = F.exists(F.slice(lines, 1, 10_000), lambda t: cut(t, "//").contains("try!("))
    blocks = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?m)^[ \t]*(//!.*|/\*!(?!.*\*/)[\s\S]*?(?:\*/|\z))"), F.lit(1))
    docs = F.array_join(F.transform(blocks, lambda d: F.regexp_replace(F.regexp_replace(d, r"(?m)^[ \t]+", ""), r"\A(?://!|/\*!(?:[ \t]*\n)?)|\*/\z", "")), "\n")
    per = rust.select("package", "path", unstable.alias("unstable"), old.alias("old"), F.when(F.col("path").rlike(r"^(src/)?lib\.rs$"), docs).alias("docs"))
    return per.groupBy("package").agg(F.bool_or("unstable").alias("is_unstable"), F.bool_or("old").alias("has_old_try"), F.coalesce(F.max_by("docs", F.when(F.col("docs").isNotNull(), F.col("path"))), F.lit("")).alias("docs"))


def clean_keyword(c: Column, weight: Column, stop_words: list[str]) -> Column:
    """(keyword, weight) without edge punctuation and language affixes; null if nothing is left; stop words weigh a tenth."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), "(-rs)+$", "")
    k = normalize_keyword(F.regexp_replace(bare, "^(rust-)+", ""))
    return F.when((k != "") & ~k.isin("rust", "rs") & (weight > 1e-6), F.struct(k.alias("keyword"), (weight * F.when(k.isin(*stop_words), 0.1).otherwise(1.0)).alias("weight")))


def namespace_prefix(c: Column) -> Column:
    """The first part of a name of more than one letter, without tool affixes; the name if it has no such part."""
    parts = F.filter(F.split(F.regexp_replace(c, "^(rust-)*(cargo-)*(lib)*", ""), "[-_]"), lambda p: F.length(p) > 1)
    return F.coalesce(F.get(parts, F.lit(0)), c)


def unprefix(c: Column) -> Column:
    """A name without its language affix: one at its begin with a separator, else one at its end, else one at its begin."""
    begin, end = "^rust[-_]", "[-_]rs$"
    return F.when(c.rlike(begin), F.regexp_replace(c, begin, "")).when(c.rlike(end), F.regexp_replace(c, end, "")).otherwise(F.regexp_replace(c, "^rust", ""))


def min_compiler(edition: Column, resolver: Column, features: Column, declared: Column) -> Column:
    """The lowest compiler a manifest allows, from edition, resolver, feature syntax and the declared version."""
    return F.greatest(
        F.when(edition >= 2024, 85).when(edition >= 2021, 56).when(edition >= 2018, 31).otherwise(1), F.when(resolver == "2", 51).when(resolver == "3", 84).otherwise(1),
        F.when(F.exists(F.flatten(F.map_values(features)), lambda f: f.startswith("dep:") | f.contains("?")), 60).otherwise(1),
        F.coalesce(F.regexp_extract(declared, r"^1\.([0-9]+)", 1).try_cast("int"), F.lit(1)),
    )


def fix_category_slugs(packages: DataFrame, taxonomy: DataFrame, n: int = 5) -> DataFrame:
    """Known slugs of packages (package, categories array), colons and case repaired, deepest first, then as declared."""
    c = packages.select("package", F.posexplode("categories").alias("place", "raw"))
    c = c.withColumn("slug", F.regexp_replace(F.regexp_replace(F.lower(F.trim("raw")), r"\s+", "-"), r"(?<!:):(?!:)", "::"))
    known = c.join(taxonomy.select("slug", "depth"), "slug").dropDuplicates(["package", "slug"])
    picked = known.groupBy("package").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "place", "slug"))), 1, n), lambda s: s["slug"]).alias("slugs"))  # a package declares a handful
    return packages.select("package").join(picked, "package", "left")


def override_categories(packages: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Rewrite a slug where any of a rule's keywords is present. ``packages``: package, slug, keywords array; rules (from, to, keywords)."""
    out = F.col("slug")
    for old, new, words in rules:
        out = F.when((F.col("slug") == old) & F.arrays_overlap("keywords", F.array(*map(F.lit, words))), new).otherwise(out)
    return packages.select("package", out.alias("slug"))


def non_dep_features(features: Column) -> Column:
    """Features that only name other features, are not hidden and not the default."""
    names = F.map_keys(features)
    fine = F.map_filter(features, lambda k, v: ~k.startswith("_") & (k != "default") & F.forall(v, lambda f: F.array_contains(names, f)))
    return F.sort_array(F.map_keys(fine))


def freshness_class(popularity: Column, is_latest: Column, lost: Column, deprecated: Column) -> Column:
    """B38."""
    return F.when(deprecated | lost, "obsolete").when(is_latest & (popularity < 0.33), "verynew").when(popularity >= 0.75, "common").when(popularity >= 0.33, "outdated").otherwise("obsolete")


def package_kinds(packages: DataFrame) -> DataFrame:
    """Kind flags from manifest columns package, name, has_bin, has_lib, links, proc_macro, categories, readme."""
    app = F.col("has_bin") & (~F.col("has_lib") | F.array_contains("categories", "command-line-utilities"))
    return packages.select(
        "package", "has_bin", "has_lib", app.alias("is_app"), (F.col("name").endswith("-sys") | F.col("links").isNotNull()).alias("is_sys"), F.col("proc_macro").alias("is_proc_macro"),
        (F.array_contains("categories", "no-std") | F.coalesce(F.col("readme").rlike(r"(?i)#?!?\[no_std\]|\bno[_-]std\b"), F.lit(False))).alias("is_no_std"),
    )


def log_to_verdict(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Build-log lines (JSON messages) to one verdict per package, version and compiler.

    ``logs``: compiler, line; ``rules``: prefix, verdict, rank (a short table).
    An error whose message begins with a rule's prefix gives its verdict, the
    strongest of a build counts; a build without an error is verified.
    """
    m = F.from_json("line", "STRUCT<reason: STRING, package_id: STRING, success: BOOLEAN, message: STRUCT<level: STRING, message: STRING>>")
    p = logs.select("compiler", m.alias("m")).where("m.package_id IS NOT NULL").select("compiler", "m.*").withColumns({"package": F.regexp_extract("package_id", r"^(\S+) (\S+)", 1), "version": F.regexp_extract("package_id", r"^(\S+) (\S+)", 2)})
    errors = p.where("message.level = 'error'").select("package", "version", "compiler", F.col("message.message").alias("text"))
    ruled = errors.join(F.broadcast(rules), F.col("text").startswith(F.col("prefix"))).groupBy("package", "version", "compiler").agg(F.max(F.struct("rank", "verdict")).alias("r"))
    fine = p.groupBy("package", "version", "compiler").agg(F.bool_or("success").alias("ok"), F.count_if(F.col("message.level") == "error").alias("n_errors"))
    verdict = F.when(F.col("r").isNotNull(), F.col("r.verdict")).when(F.col("n_errors") > 0, "N").when(F.coalesce("ok", F.lit(False)), "Y").otherwise("N")
    return fine.join(ruled, ["package", "version", "compiler"], "left").select("package", "version", "compiler", verdict.alias("verdict"))


def clean_packages(packages: DataFrame) -> DataFrame:
    """Normalised origin, links without repeats, kind of host and name checks of a package table (package, name, repository, homepage, documentation)."""
    repo = parse_repo(F.col("repository"))
    home = F.when(~F.coalesce(same_url(F.col("homepage"), F.col("repository")), F.lit(False)), F.col("homepage"))
    docs = F.when(~F.coalesce(same_url(F.col("documentation"), F.col("homepage")), F.lit(False)) & ~F.coalesce(same_url(F.col("documentation"), F.col("repository")), F.lit(False)), F.col("documentation"))
    return packages.select(
        "package", F.concat(F.lit("registry:"), F.lower("name")).alias("origin"), F.col("name").rlike("^[A-Za-z0-9_-]+$").alias("is_valid"), namespace_prefix(F.col("name")).alias("namespace"),
        repo["host"].alias("repo_host"), repo["owner"].alias("repo_owner"), home.alias("homepage"), docs.alias("documentation"), url_domain(home).alias("domain"),
    )
