"""Page-corpus audits: what pages carry, what they must, what they must not, and who defines what."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scalars as S
from ..session import cut_lineage, fits_broadcast
from . import ordered
from .rules import first_match, whole_word

# Named entities pages use, and the character each stands for.
ENTITIES = {"nbsp": " ", "mdash": "—", "ndash": "–", "middot": "·", "hellip": "…", "rsquo": "’", "lsquo": "‘",
            "rdquo": "”", "ldquo": "“", "times": "×", "rarr": "→", "larr": "←", "copy": "©", "apos": "'"}
BASIC = [("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]

# Accepted lengths of a page's title and description.
TITLE_RANGE, DESCRIPTION_RANGE = (15, 70), (50, 165)

# What every page must carry, as (label, pattern).
MUST = [("a skip link", r'class="skip-link"'), ("a main landmark", r'<main[^>]*id="main"'), ("exactly one h1", r"<h1"),
        ("a net readout", r"data-netreadout(?![0-9A-Za-z_])"), ("the instrumentation bundle", r"assets/net-[A-Z0-9]{8}\.js")]
# Inline handlers, and what a page's own script is called.
INLINE_HANDLER = r"(?i)\son(click|load|error|submit|change)="
OWN_SCRIPT = r"^/assets/[\w.-]+\.js$"
# Harness pages that are not part of the site.
HARNESS = r"^(selftest|tools-selftest|ocr-probe|readout-selftest|e2e-selftest|ocr-text-probe)\.html$"
NEGATION = whole_word("not|never|nothing|no")
TAGS = r"<(/?)(p|b|ul|li|nav|div|article|footer)[ >]"


# -- text -------------------------------------------------------------------------------------


def _code_points(text: Column, pattern: str, base: int) -> Column:
    """Numeric entities to characters: split around them, convert each, and put the text back together."""
    pieces = F.split(text, pattern)
    codes = F.regexp_extract_all(text, F.lit(pattern.replace("?:", "").replace("[0-9a-fA-F]+", "([0-9a-fA-F]+)").replace(r"\d+", r"(\d+)")), F.lit(1))
    chars = F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.conv(c, base, 16), 8, "0")), "UTF-32"))
    joined = F.concat(F.try_element_at(pieces, F.lit(1)), F.array_join(F.zip_with(
        chars, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda c, p: F.concat(c, p)), ""))
    return F.when(text.rlike(pattern), joined).otherwise(text)


def normalise(text: str | Column) -> Column:
    """Entities decoded, curly quotes straightened, white space collapsed to single spaces."""
    t = S.col(text)
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    t = _code_points(t, r"&#[xX][0-9a-fA-F]+;", 16)
    t = _code_points(t, r"&#\d+;", 10)
    for entity, char in BASIC:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.translate(t, "‘’“”", "''\"\"")
    return F.regexp_replace(t, r"(?U)\s+", " ")


def title_of(html: str | Column) -> Column:
    return F.regexp_extract(S.col(html), r"<title>([^<]*)</title>", 1)


def meta_of(html: str | Column, name: str) -> Column:
    return F.regexp_extract(S.col(html), f'<meta name="{name}" content="([^"]*)"', 1)


def build_of(html: str | Column, name: str) -> Column:
    return F.regexp_extract(S.col(html), f'<meta name="{name}" content="([0-9a-f]+)"', 1)


def body_of(html: str | Column) -> Column:
    code = F.regexp_replace(S.col(html), r"<script[\s\S]*?</script>|<style[\s\S]*?</style>", " ")
    return F.regexp_replace(code, r"<[^>]+>", " ")


def template_pattern(source: str | Column) -> Column:
    """A text with {{tokens}} as an anchored pattern: a token is any text, the rest must match as it is."""
    parts = F.split(normalise(source), r"\{\{\w+\}\}")
    escaped = F.transform(parts, lambda p: F.regexp_replace(p, r"[.*+?^${}()|\[\]\\]", r"\\$0"))
    return F.concat(F.lit("^"), F.array_join(escaped, ".+?"), F.lit("$"))


def matches_source(served: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(…, matches): whether a served text is what its source says, tokens aside. ``sources`` has one source per key; a
    text without one does not match."""
    d = served.join(sources.select(key, "source"), key, "left")
    hit = F.rlike(F.trim(normalise("text")), template_pattern("source"))
    return d.withColumn("matches", F.coalesce(hit, F.lit(False))).drop("source")


# -- page rules --------------------------------------------------------------------------------


def site_pages(pages: DataFrame, name: str) -> DataFrame:
    return pages.where(~F.col(name).rlike(HARNESS))


def metadata_audit(pages: DataFrame) -> DataFrame:
    title, description = F.length(title_of("html")), F.length(F.regexp_extract("html", 'name="description" content="([^"]*)"', 1))
    d = pages.select("page_id", title.cast("long").alias("title_chars"), description.cast("long").alias("description_chars"),
                     F.col("html").rlike('rel="canonical"').alias("canonical"), F.col("html").rlike('property="og:title"').alias("og"),
                     S.js_round(F.octet_length("html") / 1024).cast("long").alias("kb"))
    ok = F.col("title_chars").between(*TITLE_RANGE) & F.col("description_chars").between(*DESCRIPTION_RANGE)
    return d.withColumn("flagged", ~(ok & F.col("canonical") & F.col("og")))


def invariant_problems(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    h1 = F.regexp_count("html", F.lit("<h1"))
    rules = [F.when(~html.rlike(p), F.lit(f"missing {label}")) for label, p in MUST]
    rules.append(F.when(h1 != 1, F.concat(h1, F.lit(" h1 elements"))))
    rules.append(F.when(html.rlike(INLINE_HANDLER), F.lit("inline event handler")))
    return pages.select("page_id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def foreign_scripts(pages: DataFrame) -> DataFrame:
    """Scripts a page did not get from its own build; structured data is not code."""
    tags = F.regexp_extract_all("html", F.lit(r"<script(?![0-9A-Za-z_])([^>]*)>"), F.lit(1))
    code = F.filter(tags, lambda t: ~t.rlike(r'type="application/ld\+json"'))
    src = F.transform(code, lambda t: F.when(t.rlike(r'\bsrc="'), F.regexp_extract(t, r'\bsrc="([^"]*)"', 1)).otherwise(F.lit("inline script")))
    bad = F.array_distinct(F.filter(src, lambda s: ~s.rlike(OWN_SCRIPT)))
    return pages.select("page_id", F.explode(bad).alias("script"))


def sentences(text: str | Column) -> Column:
    """Sentences, cut after . ! or ? by putting a mark there first (no look-behind needed)."""
    return F.split(F.regexp_replace(S.col(text), r"([.!?])\s+", "$1\u0001"), "\u0001")


def claiming_sentences(docs: DataFrame, key: str, text: str, claim: str) -> DataFrame:
    """Sentences with the shape of a claim and no negation in them."""
    d = docs.select(key, F.posexplode(sentences(text)).alias("n", "sentence"))
    return d.where(F.col("sentence").rlike(claim) & ~F.col("sentence").rlike(NEGATION))


def missing_fields(required: list[str], least: int = 3) -> Column:
    """Names of the required fields that are missing, blank or shorter than three characters."""
    return F.array_join(F.array_compact(F.array(*[
        F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) < least, F.lit(c)) for c in required])), ",")


def scoped_hits(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """Forbidden tokens, each looked for in its own scope: script bodies or the whole text.

    The rule list is fixed text in code, so it is tested in place and no join is made.
    """
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"<script[^>]*>([\s\S]*?)</script>"), F.lit(1)), "\n")
    d = pages.select(key, "html", scripts.alias("_js"))
    hits = F.array_compact(F.array(*[
        F.when(F.contains(F.col("_js" if scope == "script" else "html"), F.lit(token)), F.struct(F.lit(scope).alias("scope"), F.lit(token).alias("token")))
        for scope, token in rules]))
    return d.select(key, F.explode(hits).alias("h")).select(key, "h.*")


# -- phrases -----------------------------------------------------------------------------------


def folded(text: str | Column) -> Column:
    """Lower case, white space collapsed: how a reader sees a phrase that wraps over a line."""
    return F.regexp_replace(F.lower(S.col(text)), r"\s+", " ")


GRAM = 3
GRAM_ROWS = 4096  # texts that meet one key in one task
KEYS_HELD = 1_000_000  # keys sent to every task to leave out grams that no phrase is looked up by


def phrase_hits(texts: DataFrame, key: str, phrases: DataFrame, fits: bool | None = None) -> DataFrame:
    """(key, phrase_id) where the text holds the phrase. ``texts`` has key, text; ``phrases`` phrase_id, phrase.

    A phrase list measured to be small goes to every task as one automaton, which reads each text once for all phrases.
    A larger one is looked up by the phrases' rarest grams. An empty phrase hits nothing.
    """
    if fits is None:
        fits = fits_broadcast(phrases, ["phrase"])
    phrases = phrases.where("phrase <> ''").select("phrase_id", "phrase")
    return _by_automaton(texts, key, phrases) if fits else _by_rarest_gram(texts, key, phrases)


def _by_automaton(texts: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """One pass over the texts; ``phrases`` is within the bounds of a broadcast."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast([(r["phrase"], r["phrase_id"]) for r in phrases.collect()])
    id_type = phrases.schema["phrase_id"].dataType
    schema = T.StructType([texts.schema[key], T.StructField("phrase_id", id_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list] = {}
        for phrase, i in held.value:
            ids.setdefault(phrase, []).append(i)
        find = ahocorasick.Automaton()
        for phrase in ids:
            find.add_word(phrase, phrase)
        find.make_automaton()
        for batch in batches:
            at, hits = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = {p for _, p in find.iter(text)} if text and ids else ()
                for p in found:
                    at += [row] * len(ids[p])
                    hits += ids[p]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, to_arrow_type(id_type))], names=schema.names)

    return texts.select(key, "text").mapInArrow(run, schema)


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def gram_kinds(phrases: DataFrame) -> tuple[bool, bool, list[int]]:
    """Which grams the phrases are looked up by: words (phrases of three), pairs (of more), runs of these lengths (of fewer)."""
    words = F.size(F.split("phrase", " "))
    run = F.when(words <= 2, F.least(F.length("phrase"), F.lit(GRAM)))
    got = phrases.select(F.least(words, F.lit(4)).alias("w"), run.alias("n")).distinct().collect()
    return any(r["w"] == 3 for r in got), any(r["w"] == 4 for r in got), sorted({r["n"] for r in got if r["n"]})


def text_grams(text: str, kinds: tuple[bool, bool, list[int]]) -> Column:
    """A text's distinct grams of these kinds."""
    w, (words, pairs, lengths) = F.split(text, " "), kinds
    parts = [w] * words + [_pairs(w)] * pairs
    parts += [F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit("\0"), g)) for n in lengths]
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def phrase_grams(phrase: str) -> Column:
    """The grams that any text holding the phrase must have: the pairs of words strictly inside it (the word, if there is
    one), or of one or two words its runs of three characters, or fewer if it has no more."""
    w = F.split(phrase, " ")
    inner = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
    n = F.least(F.length(phrase), F.lit(GRAM))
    runs = F.transform(F.sequence(F.lit(1), F.length(phrase) - n + 1), lambda i: F.concat(F.lit("\0"), F.col(phrase).substr(i, n)))
    return F.array_distinct(F.when(F.size(w) == 3, inner).when(F.size(w) > 3, _pairs(inner)).otherwise(runs))


def keyed_phrases(texts: DataFrame, phrases: DataFrame, kinds: tuple[bool, bool, list[int]]) -> DataFrame:
    """(phrase_id, phrase, gram, salts): each phrase with the gram that fewest texts have, and how many parts those texts
    are cut into. Phrases with a gram that no text has are left out: nothing can hold them."""
    wanted = phrases.select("phrase_id", "phrase", F.explode(phrase_grams("phrase")).alias("gram"))
    asked = cut_lineage(wanted.select("gram").distinct())
    found = texts.select(F.explode(text_grams("text", kinds)).alias("gram"))
    if asked.count() <= KEYS_HELD:  # so that grams no phrase has are not even counted
        found = found.join(F.broadcast(asked), "gram", "left_semi")
    found = found.groupBy("gram").agg(F.count("*").alias("texts"))
    d = wanted.join(found, "gram", "left").groupBy("phrase_id", "phrase").agg(
        F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.min("texts").alias("texts"), F.count_if(F.col("texts").isNull()).alias("absent"))
    return d.where("absent = 0").select("phrase_id", "phrase", "gram", F.ceil(F.col("texts") / GRAM_ROWS).cast("int").alias("salts"))


def _salted(texts: DataFrame, key: str, keys: DataFrame, kinds: tuple[bool, bool, list[int]]) -> DataFrame:
    """(key, text, gram, salt) of the texts' grams that some phrase is looked up by."""
    d = texts.select(key, "text", F.explode(text_grams("text", kinds)).alias("gram"))
    by_gram = keys.groupBy("gram").agg(F.max("salts").alias("salts"))
    if by_gram.count() <= KEYS_HELD:
        d = d.join(F.broadcast(by_gram), "gram")
    else:  # the parts of the common ones alone; grams that no phrase has go on and meet nothing
        d = d.join(F.broadcast(by_gram.where("salts > 1")), "gram", "left")
    return d.select(key, "text", "gram", F.pmod(F.xxhash64(key), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))


def _by_rarest_gram(texts: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """Texts and phrases meet on (gram, part); a text travels once per key it has, and equality of the whole decides."""
    kinds = gram_kinds(phrases)
    keys = cut_lineage(keyed_phrases(texts, phrases, kinds))
    parts = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = _salted(texts, key, keys, kinds).join(parts.select("gram", "salt", "phrase_id", "phrase"), ["gram", "salt"])
    return found.where(F.contains("text", F.col("phrase"))).select(key, "phrase_id")


def hit_rollup(hits: DataFrame, key: str, named: int = 4) -> DataFrame:
    """Pages per phrase and the first four of them by key. Only those four are gathered."""
    hits = cut_lineage(hits)  # few rows, found once by reading all texts
    per = hits.groupBy("phrase_id").agg(F.count("*").alias("pages"))
    first = first_n(hits, ["phrase_id"], key, named)
    names = first.groupBy("phrase_id").agg(F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("named"))
    return per.join(names, "phrase_id")


def first_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """First n rows of each group by ``order``. Spark pushes the limit below the shuffle (WindowGroupLimit),
    so every task sends at most n rows of a group."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def mention_starts(text: Column, phrase: str) -> Column:
    """Where each mention starts: the text is cut at the phrase and the piece lengths are summed."""
    pieces = F.split(text, _quote(phrase))
    step = len(phrase)
    return F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.array().cast("array<long>"),
                       lambda acc, p: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)) + step, F.lit(0)) + F.length(p)).cast("long"))))


def _quote(phrase: str) -> str:
    return re.escape(phrase)


def unknown_phrasings(texts: DataFrame, key: str, text: str, phrase: str, known: list[str], before: int = 60, after: int = 30) -> DataFrame:
    """Mentions whose surroundings match no known phrasing. Row by row: nothing is shuffled."""
    m = texts.select(key, F.col(text).alias("text"), F.explode(mention_starts(F.col(text), phrase)).alias("at"))
    start = F.greatest(F.col("at") - before, F.lit(0).cast("long"))
    around = F.substring(F.col("text"), (start + 1).cast("int"), (F.col("at") + after - start).cast("int"))
    m = m.select(key, "at", around.alias("around"))
    return m.where(~reduce(lambda a, b: a | b, [F.col("around").rlike(k) for k in known]))


NEAR = 1500


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def nearest_gap(pages: DataFrame, key: str, text: str, shapes: dict[str, list[str]], line: str, near: int = NEAR) -> DataFrame:
    """(key, shape, gap, near) for every shape whose marks a page carries all: the distance from the span of the
    marks to the nearest mention of ``line``, and whether it is within ``near`` characters.

    0 inside the span, NULL when the line is nowhere. White space counts as one space, in the page, the marks and
    the line. Worked out inside each row.
    """
    fold = lambda s: re.sub(r"\s+", " ", s)
    d = pages.select(key, one_space(S.col(text)).alias("_t"))
    spans = []
    for name, marks in shapes.items():
        at = [F.instr("_t", fold(m)) - 1 for m in marks]
        first, last = F.array_min(F.array(*at)), F.array_max(F.array(*at))
        ends = F.array_max(F.array(*[F.when(a == last, a + len(fold(m))) for a, m in zip(at, marks)]))
        spans.append(F.when(first >= 0, F.struct(F.lit(name).alias("shape"), first.alias("lo"), ends.alias("hi"))))
    d = d.select(key, F.explode(F.array_compact(F.array(*spans))).alias("s"), mention_starts(F.col("_t"), fold(line)).alias("starts"))
    lo, hi = F.col("s.lo"), F.col("s.hi")
    gap = F.array_min(F.transform("starts", lambda i: F.when(i.between(lo, hi), 0).when(i < lo, lo - i).otherwise(i - hi))).cast("long")
    d = d.select(key, "s.shape", gap.alias("gap"))
    return d.withColumn("near", F.coalesce(F.col("gap") <= near, F.lit(False)))


# -- definitions, reconciliation ---------------------------------------------------------------


def missing_definitions(used: DataFrame, defined: DataFrame, named: int = 4) -> DataFrame:
    """Names used and never defined, on how many pages, and the first few of them."""
    gone = cut_lineage(used.distinct().join(defined.select("name").distinct(), "name", "left_anti"))
    counts = gone.groupBy("name").agg(F.count("*").alias("pages"))
    first = first_n(gone, ["name"], "page_id", named)
    text = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("first_pages"))
    return counts.join(text, "name")


def twice_defined(defs: DataFrame, name: str) -> DataFrame:
    return defs.groupBy(name).agg(F.count("*").alias("times")).where("times > 1")


def snapshot_update(current: DataFrame, stored: DataFrame, today: str) -> DataFrame:
    """key -> (sha, date): unchanged pages keep their date, changed and new ones get today's, unseen keys stay."""
    c = current.select("key", F.col("sha").alias("_new"))
    s = stored.select("key", F.col("sha").alias("_old"), F.col("date").alias("_date"))
    same = F.coalesce(F.col("_new") == F.col("_old"), F.lit(False))
    return c.join(s, "key", "full").select(
        "key", F.coalesce("_new", "_old").alias("sha"),
        F.when(F.col("_new").isNull() | same, F.col("_date")).otherwise(F.lit(today)).alias("date"))


def claim_vs_count(claims: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A stated number against counted rows, for keys on either side."""
    counted = rows.groupBy(key).agg(F.count("*").alias("counted"))
    d = claims.join(counted, key, "full").withColumn("counted", F.coalesce("counted", F.lit(0).cast("long")))
    return d.withColumn("agrees", F.coalesce(F.col("claimed") == F.col("counted"), F.lit(False)))


def carries_all(carried: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys that carry every wanted feature. ``wanted`` is a list of feature names."""
    n = wanted.distinct().agg(F.count("*")).scalar()
    hit = carried.distinct().join(wanted.distinct(), "feature")
    return hit.groupBy(key).agg(F.count("*").alias("features")).where(F.col("features") == n)


def either_orphan(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that has it."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    d = left.join(right, key, "full").where("_a is null or _b is null")
    return d.select(key, F.when(F.col("_a").isNull(), F.lit("written-only")).otherwise(F.lit("advertised-only")).alias("side"))


def marker_problems(markers: DataFrame, key: str) -> DataFrame:
    """Opening and closing marks must alternate and agree. ``markers``: key, n (position), close, kind.

    Needs only each mark's neighbours, so it runs on chunks of any size.
    """
    mark = F.struct(F.col("close"), F.col("kind"))
    chunk = ordered.chunk_of("n")
    d = ordered.neighbours(markers, [key], ["n"], chunk, mark, prev="_prev", nxt="_next")
    prev, nxt = F.col("_prev.v"), F.col("_next.v")
    opened = prev.isNotNull() & ~F.coalesce(prev["close"], F.lit(True))
    problem = first_match([
        (~F.col("close") & opened, "opened-inside"), (F.col("close") & ~opened, "nothing-open"),
        (F.col("close") & (prev["kind"] != F.col("kind")), "closes-other"), (~F.col("close") & nxt.isNull(), "never-closed")])
    return d.withColumn("problem", problem).where("problem is not null").select(key, "n", "kind", "problem")


def numbering_problems(headings: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """Headings whose number is not their position."""
    d = ordered.number(headings, [key], [order], ordered.chunk_of(order), "expected")
    return d.where(F.col(number) != F.col("expected"))


PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # products of two remainders fit a long
BASES = (1103515245, 1664525, 22695477, 134775813)


def _power(base: int, n: Column, prime: int) -> Column:
    """base ** n modulo prime, for n below 2**31: one factor per binary digit."""
    out, square = F.lit(1).cast("long"), base % prime
    for digit in range(31):
        out = out * F.when(F.getbit(n, F.lit(digit)) == 1, F.lit(square)).otherwise(F.lit(1)).cast("long") % prime
        square = square * square % prime
    return out


def list_fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """(key, length, print) of the lists whose rows are (key, n, item), n from 0.

    A polynomial of the items' hashes in the place: order counts, yet the rows add up in any order and any parts, so
    every task sends one row per list. About 120 bits.
    """
    item = F.struct(F.col("item").isNull(), F.col("item"))
    n = F.col("n").cast("long")
    terms = [F.pmod(F.xxhash64(F.lit(i), item), F.lit(p)) * _power(b, n, p) % p for i, (b, p) in enumerate(zip(BASES, PRIMES))]
    d = rows.select(key, *[t.alias(f"_{i}") for i, t in enumerate(terms)])
    sums = [F.pmod(F.sum(f"_{i}"), F.lit(p)) for i, p in enumerate(PRIMES)]
    return d.groupBy(key).agg(F.count("*").alias("length"), F.array(*sums).alias("print"))


def followed_by(length: Column, first: Column, second: Column) -> Column:
    """The print of a list from the prints of its two parts: the second one's places move on by the first one's length."""
    return F.array(*[(first[i] + second[i] * _power(b, length, p)) % p for i, (b, p) in enumerate(zip(BASES, PRIMES))])


def same_order(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two ordered lists per key: whether they are equal, and the places where they differ.

    Lists of equal fingerprints are equal. Only the others meet place by place, in a full join on (key, place).
    """
    left = list_fingerprints(a, key).select(key, F.struct("length", "print").alias("_l"))
    right = list_fingerprints(b, key).select(key, F.struct("length", "print").alias("_r"))
    both = cut_lineage(left.join(right, key, "full").select(key, F.col("_l").eqNullSafe(F.col("_r")).alias("same")))
    unlike = both.where("not same").select(key)
    d = a.join(unlike, key, "left_semi").select(key, "n", F.col("item").alias("_a"), F.lit(True).alias("_ina")).join(
        b.join(unlike, key, "left_semi").select(key, "n", F.col("item").alias("_b"), F.lit(True).alias("_inb")), [key, "n"], "full")
    ok = F.col("_ina").isNotNull() & F.col("_inb").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    differing = d.groupBy(key).agg(F.bool_and(ok).alias("equal"), F.count_if(~ok).alias("differences"))
    return both.where("same").select(key, F.lit(True).alias("equal"), F.lit(0).cast("long").alias("differences")).unionByName(differing)


def schema_drift(records: DataFrame, kind: str, json: str, declared: list[str]) -> DataFrame:
    """Per kind of record: fields that some record stores and nobody declared, and declared ones that none stores.

    Field names fold to one row per kind and name before they meet.
    """
    stored = records.select(kind, F.explode(F.json_object_keys(json)).alias("field")).distinct()
    wanted = records.select(kind).distinct().select(kind, F.explode(F.array(*[F.lit(f) for f in declared])).alias("field"))
    sides = stored.withColumn("s", F.lit(1)).join(wanted.withColumn("d", F.lit(1)), [kind, "field"], "full")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("field")))), ",")
    return sides.groupBy(kind).agg(names(F.col("d").isNull()).alias("undeclared"), names(F.col("s").isNull()).alias("absent"))


def implications(pages: DataFrame, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Per (carrier, needs): how many texts carry the first, and whether each of them has the second.

    A rule nothing carries does not hold: an empty check proves nothing. One pass over the texts, and
    each rule's partial answer is one row per task.
    """
    facts = F.array(*[F.struct(F.lit(a).alias("carrier"), F.lit(b).alias("needs"), F.contains(F.col(text), F.lit(a)).alias("has"),
                               F.contains(F.col(text), F.lit(b)).alias("ok")) for a, b in rules])
    d = pages.select(F.explode(facts).alias("f")).select("f.*")
    return d.groupBy("carrier", "needs").agg(F.count_if("has").alias("carriers"), F.bool_and(F.when(F.col("has"), F.col("ok"))).alias("_ok")).select(
        "carrier", "needs", "carriers", F.coalesce("_ok", F.lit(False)).alias("holds"))


def expected_phrases(pages: DataFrame, text: Column, expected: list[tuple[str, bool]]) -> DataFrame:
    """Each named phrase, whether it should be somewhere, and whether it is anywhere."""
    d = pages.select(text.alias("_t")).agg(*[F.bool_or(F.contains("_t", F.lit(p))).alias(f"p{i}") for i, (p, _) in enumerate(expected)])
    rows = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("expected"), F.coalesce(f"p{i}", F.lit(False)).alias("found")) for i, (p, w) in enumerate(expected)])
    return d.select(F.explode(rows).alias("r")).select("r.*")
