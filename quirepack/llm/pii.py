"""Personal data: fixed base patterns, then bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are the seeds: the first accepted instances.
A lexical pattern is the word, or the two words, before a place. Its instances are
the seeds and the free candidates that stand there: tokens with a digit, tokens with
an @ and groups of digits with blanks, brackets, points or hyphens between them,
which meet no base span. Patterns and instances form a graph, and each of at most
ROUNDS rounds

  scores patterns:  sum of its accepted instances' scores by kind, a place each,
                    over all occurrences of its words in the corpus
  accepts patterns: of MIN_CONFIDENCE or more, with MIN_SEEDS different accepted
                    instances of that kind or more
  scores instances: 1 - product of (1 - score) of its accepted patterns
  accepts instances of MIN_CONFIDENCE or more,

so that instances found in one round induce patterns in the next; it ends when a
round accepts nothing new. Free candidates behind an accepted pattern are further
spans of the pattern's kind. Patterns whose places are too few for MIN_CONFIDENCE
whatever stands there take no part. A candidate behind several accepted patterns gets
the kind of the best score, the earlier kind of equal ones. Words are runs of letters and digits
in lower case; GAP other characters at most, and no line end, may stand between a word
and what follows. A word is looked for in the TAIL characters before a place and counts
as none where it is cut there. Behind another identifier there is no pattern.

All steps are DataFrame or SQL functions. Places come from sums inside chunks of CHUNK
matches and over chunks, so long texts take linear time, and overlaps from running
maxima over the spans of a row. Rows are told apart by their place in the input:
texts that many rows share meet in no task. Occurrences are counted for words that
stand before MIN_SEEDS different instances or more, with map-side sums.

Positions are code points, ends exclusive. Nulls and empty texts have no spans.
Repeated rows get the same spans. Regular expressions are possessive, so long
runs of letters or digits take linear time and no deep stack. Other columns of the
input are not read by find and stay as they are in redact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import numbered, plain, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 6
MIN_CONFIDENCE = 0.5
MIN_SEEDS = 3
CHUNK = 128
TAIL = 256
GAP = 4
ROW = "__row"
#: Patterns (some 100 bytes each) that are broadcast; more are joined.
MAX_BROADCAST_PATTERNS = 200_000
#: Discovered spans that are broadcast to the texts they are redacted in; more are joined.
MAX_BROADCAST_SPANS = 500_000
#: The leftmost matches of the contract's patterns: where a run of a leading class
#: fails at its first character it fails at all, so only run starts are tried.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the pattern.
NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+"}
DIGITS_SOON = "[0-9][.0-9 -]"
#: Free candidates: tokens with an @, two to eight groups of digits, tokens with a digit.
CANDIDATE = (
    r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
    r"|(?<![\p{L}0-9+(])[+(]{0,2}+[0-9]++(?:[ ()./-]{1,3}+[0-9]++){1,7}+(?!\p{L})"
    r"|(?<![A-Za-z0-9@._+-])[A-Za-z@._+-]*+[0-9][A-Za-z0-9@._+-]*+"
)
WORD = r"[\p{L}\p{N}]"
SPAN = "array<struct<start:int,no:int,kind:string,end:int,value:string,tail:string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once; a repeated reference would be computed again and again."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))


def _scanned(items: Column, kind: str, total: Callable[[Column, Column], Column], step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A running result over items: step gives the new state (an int, 0 at first) and what to put out; total the state after an item.

    States are computed for whole chunks first, so no list is copied more than CHUNK times.
    """
    none = F.array().cast(kind)

    def one(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(out)).alias("out"))

    def run(chunks: Column) -> Column:
        # the state before each chunk
        before = F.aggregate(
            chunks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, c: F.struct(F.aggregate(c, acc["at"], total).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        parts = F.zip_with(chunks, before, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), one, lambda acc: acc["out"]))
        return F.flatten(parts)

    return _bound(items, lambda xs: F.when(F.size(xs) > 0, _bound(_chunks(xs, F.size(xs)), run)).otherwise(none))


def _located(text: Column, pattern: str, no: int, kind: str) -> Column:
    """All matches as spans: the pieces between matches give the places, and their ends what stands before."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("long"), m.alias("value"), F.right(p, F.lit(TAIL)).alias("tail")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["gap"], at + x["gap"] + x["long"]
        return end, F.struct(start.alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"), x["tail"].alias("tail"))

    return _scanned(pairs, SPAN, lambda at, x: at + x["gap"] + x["long"], step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    n = F.length(digits)
    return F.when((n >= 14) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str) -> Callable[[Column], Column]:
    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return F.when(F.length(plain) > 3, False).otherwise(F.when(plain == "", 0).otherwise(plain.cast("int")) <= 255)

    return {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), small),
        "card": lambda s: _luhn(s["value"]),
        "phone": lambda s: F.length(_digits(s["value"])).between(10, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    none, kinds = F.array().cast(SPAN), []
    for no, kind in enumerate(KINDS):
        maybe = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike(DIGITS_SOON)
        spans = F.filter(_located(text, PATTERNS[kind], no, kind), _valid(kind))
        kinds.append(F.when(maybe, spans).otherwise(none))
    return F.sort_array(F.concat(*kinds))


def _words_before(tail: Column) -> Column:
    """The patterns of what stands before a place: its last word, and its last two words."""
    apart = rf"[^\p{{L}}\p{{N}}\n]"
    # a word that begins where the tail was cut is not known as a whole
    whole = F.when(F.length(tail) < TAIL, F.concat(F.lit(" "), tail)).otherwise(tail)
    one = F.regexp_extract(whole, rf"(?<!^)(?<!{WORD})({WORD}++){apart}{{0,{GAP}}}+\z", 1)
    two = F.regexp_extract(whole, rf"(?<!^)(?<!{WORD})({WORD}++{apart}{{1,{GAP}}}+{WORD}++){apart}{{0,{GAP}}}+\z", 1)
    return F.filter(F.array(F.lower(one), F.regexp_replace(F.lower(two), r"[^\p{L}\p{N}]++", " ")), lambda w: w != "")


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base (spans) and places: all base spans and candidates (kind '', which may meet base spans) with their patterns."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("base", base_spans(F.col(text)))
    candidates = F.when(t.rlike("[0-9@]"), _located(t, CANDIDATE, -1, "")).otherwise(F.array().cast(SPAN))
    place = lambda s: F.struct(*(s[k].alias(k) for k in ("start", "kind", "end", "value")), _words_before(s["tail"]).alias("patterns"))
    return out.withColumn("places", F.transform(F.concat("base", candidates), place)).withColumn("base", F.transform("base", lambda s: s.dropFields("tail")))


def free_slots(rows: DataFrame) -> DataFrame:
    """(ROW, start, end, kind, value, patterns) of all base spans and of the candidates that meet none."""
    each = rows.where(F.size("places") > 0).select(ROW, F.explode("places").alias("s")).select(ROW, "s.*")
    base = F.col("kind") != ""
    along = Window.partitionBy(ROW).orderBy("start", F.desc(base))
    before = F.max(F.when(base, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy(ROW).orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1))
    met = each.withColumn("__before", before).withColumn("__after", after)
    free = base | ((F.coalesce("__before", F.lit(0)) <= F.col("start")) & (F.coalesce("__after", "end") >= F.col("end")))
    return met.where(free).drop("__before", "__after")


def occurrences(df: DataFrame, wanted: DataFrame, few: bool, text: str = "text") -> DataFrame:
    """(pattern, total): how often each wanted pattern's words stand in the texts, one directly after the other."""
    def both(words: Column) -> Column:
        n = F.size(words) - 1
        pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(n >= 1, F.concat(words, pairs)).otherwise(words)

    words = _bound(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"{WORD}++"), F.lit(0)), both)
    own = wanted.select("pattern")
    return df.select(F.explode(words).alias("pattern")).join(F.broadcast(own) if few else own, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def _kind_no(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1


def learned_patterns(slots: DataFrame, df: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Accepted patterns (pattern, kind, confidence), from free_slots and the texts."""
    edges = written(slots.select("kind", "value", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "edges")
    possible = written(edges.groupBy("pattern").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= MIN_SEEDS), "possible")
    few = possible.count() <= MAX_BROADCAST_PATTERNS
    small = F.broadcast if few else lambda d: d
    own = possible.join(small(occurrences(df, possible, few, text)), "pattern").where(F.col("places") >= MIN_CONFIDENCE * F.col("total")).select("pattern", "total")
    graph = written(edges.join(small(written(own, "patterns")), "pattern"), "graph")
    seeds = written(graph.where("kind <> ''").groupBy("value").agg(F.max("kind").alias("k")).select("value", "k", F.lit(1.0).alias("score")), "seeds")
    fresh = graph.where("kind = ''").select("pattern", "value").join(seeds.select("value"), "value", "left_anti")
    accepted, before = seeds, None
    for _ in range(rounds):
        support = graph.join(accepted, "value").groupBy("pattern", "k").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count(F.lit(1)).alias("different"), F.first("total").alias("total"))
        confidence = F.round(F.least(F.col("mass") / F.col("total"), F.lit(1.0)), 9)
        best = support.where(F.col("different") >= MIN_SEEDS).select("pattern", F.struct(confidence.alias("confidence"), (-_kind_no(F.col("k"))).alias("no"), F.col("k").alias("kind")).alias("b"))
        learned = written(best.groupBy("pattern").agg(F.max("b").alias("b")).select("pattern", "b.kind", "b.confidence").where(F.col("confidence") >= MIN_CONFIDENCE), "learned")
        miss = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999999))))
        scored = fresh.join(learned, "pattern").groupBy("value", "kind").agg(F.round(1 - F.exp(miss), 9).alias("score"))
        top = scored.groupBy("value").agg(F.max(F.struct("score", (-_kind_no(F.col("kind"))).alias("no"), "kind")).alias("b"))
        found = top.select("value", F.col("b.kind").alias("k"), F.col("b.score").alias("score")).where(F.col("score") >= MIN_CONFIDENCE)
        accepted = written(seeds.union(found), "accepted")
        state = (learned.count(), accepted.count())
        if state == before:
            break
        before = state
    return learned


def _discovered(rows: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(ROW, more): the discovered spans of each row that has any, from rows with places and the numbered texts."""
    slots = written(free_slots(rows), "slots")
    patterns = learned_patterns(slots, texts, text)
    few = patterns.count() <= MAX_BROADCAST_PATTERNS
    found = slots.where("kind = ''").select(ROW, "start", "end", "value", F.explode("patterns").alias("pattern")).join(F.broadcast(patterns) if few else patterns, "pattern")
    best = found.groupBy(ROW, "start", "end", "value").agg(F.max(F.struct("confidence", (-_kind_no(F.col("kind"))).alias("no"), "kind")).alias("b"))
    span = F.struct("start", (-F.col("b.no")).alias("no"), F.col("b.kind").alias("kind"), "end", "value")
    return written(best.select(ROW, span.alias("span")).groupBy(ROW).agg(F.sort_array(F.collect_list("span")).alias("more")), "discovered")


def _with_more(base: Column, more: Column) -> Column:
    return F.when(more.isNull(), base).otherwise(F.sort_array(F.concat(base, more)))


def find(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of df: key, base (spans), spans (base and discovered, by start and kind)."""
    texts = numbered(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), ROW)
    rows = written(with_candidates(texts).select(ROW, "key", "base", "places"), "pii")
    more = _discovered(rows, texts, "text")
    out = rows.drop("places").join(more.withColumnRenamed(ROW, "__r"), F.col(ROW) == F.col("__r"), "left")
    return out.select(F.col("key").alias(key), "base", _with_more(F.col("base"), F.col("more")).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans give one mark, of the first."""
    kind = "array<struct<fresh:boolean,from:int,start:int,kind:string>>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        fresh = s["start"] >= at
        return F.greatest(at, s["end"]), F.struct(fresh.alias("fresh"), at.alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))

    marks = F.filter(_scanned(spans, kind, lambda at, s: F.greatest(at, s["end"]), step), lambda m: m["fresh"])
    parts = F.transform(marks, lambda m: F.concat(F.substring(text, m["from"] + 1, m["start"] - m["from"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its personal data replaced in the text; other columns as they are, null texts null."""
    df, names = plain(df)
    text = names[text]
    texts = numbered(df, ROW)
    rows = written(with_candidates(texts.select(ROW, F.col(text).alias("text"))).select(ROW, "places"), "pii")
    more = _discovered(rows, texts.select(ROW, F.col(text).alias("text")), "text")
    few = (more.agg(F.sum(F.size("more"))).first()[0] or 0) <= MAX_BROADCAST_SPANS
    joined = texts.join(F.broadcast(more) if few else more, ROW, "left")
    # base spans are found again here, so that no text is dealt out
    spans = F.when(F.col(text).rlike("[0-9@+]") | F.col("more").isNotNull(), _with_more(F.transform(base_spans(F.col(text)), lambda s: s.dropFields("tail")), F.col("more")))
    body = _bound(spans, lambda x: redacted(F.col(text), x))
    return joined.withColumn(text, F.coalesce(body, F.col(text))).select(*names.values()).toDF(*names)


def op9(docs: DataFrame) -> DataFrame:
    rows = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
