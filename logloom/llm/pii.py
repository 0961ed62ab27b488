"""Personal data, by rules and by bootstrapped contextual extraction. DataFrame functions only.

Rules give the base spans (emails, addresses, cards, phone numbers). Mentions are all identifier-like strings (with a
digit, or connected by @ . _ + -; a number runs on over the single spaces, points, hyphens and brackets between its
groups of digits). Mentions that a rule takes whole are the seeds, and the one and two words before a mention are its
lexical patterns. In the graph of patterns and distinct strings (numbers are the same if their digits are), a
pattern's confidence for a kind is the summed score of its strings over their number (plus one, which holds small
patterns down), a seed's score is 1 for its kind, and any other string's is its best pattern's confidence; this is
iterated ROUNDS times. Patterns of CONFIDENCE or more with SEEDS seeds at least mark their other mentions as spans of
their kind. Base spans stay; new ones never overlap them.

Texts are scanned once; what is written between the steps is as long as the mentions found. Patterns and strings are
scored by joins of distinct pairs, aggregated map-side, so a frequent string or pattern is one row per partner. Marked
mentions meet the base spans by their places, in stretches of STRETCH characters.

Null texts are empty. Rows that are equal in id and text get equal spans; rows of one id with different texts are
different documents; null ids are kept. An empty table gives an empty result. Other columns are passed by redact(),
whatever their names, and not read elsewhere. Offsets are code points, ends exclusive. Texts of any length are read
whole, in time linear in them and in their matches (up to BLOCK ** 3 of these; beyond, blocks of as many are added up
one by one); the patterns below have no step back over more than one character class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import materialize, unused

# The kinds in their order. A match starts where a run of its first class does or where the match
# before ended; as any other start in a run fails like the run's, this finds the same as without, in linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like string: a number, whose groups of digits may stand apart as those of cards and phones do, or
#: runs of letters and digits with single connectors, a digit or an @ in it. An address's digits join no others.
_GROUP = r"(?![0-9]++\.[0-9]++\.[0-9]++\.[0-9])[0-9]++(?![A-Za-z@_+])"
_NUMBER = rf"(?:\([0-9]++\)[\x20.-]?+(?=[0-9]))?+[0-9]++(?:[.-][0-9]++(?![A-Za-z@_+])|(?<![0-9]\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}})\x20{_GROUP}|[\x20.-]?\([0-9]++\)[\x20.-]?{_GROUP})*+(?![A-Za-z0-9@_+]|[.-][A-Za-z0-9])"
_TOKEN = r"[A-Za-z0-9]++(?:[@._+-][A-Za-z0-9]++)*+"
MENTION = rf"(?<![A-Za-z0-9@._+-])(?=[@._+-]*+\([0-9]|[A-Za-z._+-]*+[0-9@])[@._+-]*+(?:{_NUMBER}|{_TOKEN})"

ROUNDS, CONFIDENCE, SEEDS, BLOCK, STRETCH, CHUNK = 3, 0.7, 3, 128, 256, 4096
_SPANS = "array<struct<start:int,end:int>>"


def running(values: Column, with_: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each of an array of whole numbers, those before it put together (0 for the first): in blocks of BLOCK, whose
    totals are treated alike. Each step is bound to a variable, so that it is worked out once."""
    fold = lambda part: F.aggregate(part, F.lit(0), with_)
    if levels == 0:
        return let(values, lambda v: F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i))))

    def of(blocks: Column) -> Column:
        inside = lambda block, start: F.transform(running(block, with_, 0), lambda x: with_(start, x))
        return let(running(F.transform(blocks, fold), with_, levels - 1), lambda starts: F.flatten(F.zip_with(blocks, starts, inside)))

    last = lambda v: F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")
    return let(let(values, lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))), of)


def _places(gaps: Column, matches: Column) -> Column:
    """Start and end of each match from the pieces between."""
    steps = F.transform(matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("len")))
    before = lambda s: running(F.transform(s, lambda x: x["gap"] + x["len"]), lambda a, x: a + x)
    place = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"))
    return F.when(F.size(matches) > 0, let(steps, lambda s: F.zip_with(s, before(s), place))).otherwise(F.array().cast(_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, less 9 above 9; the sum must divide by 10."""
    n = F.length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, r"\A0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, base, mentions), one row per document. mark: a hash of the text. base: spans (start, kind, end)
    in the order of start and kind, which is a number. mentions: (start, end, value, before, seed); seed: the kind of
    the rule that takes the whole mention."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    found = rows.select("doc_id", "text", at.alias("at"), digit.alias("digit"))
    wanted = {"email": (EMAIL, F.col("at")), "ip": (IP, F.col("digit") & text.rlike(r"[0-9]\.[0-9]")), "card": (CARD, F.col("digit")), "phone": (PHONE, F.col("digit") & F.contains(text, F.lit("+"))), "mention": (MENTION, F.col("digit") | F.col("at"))}
    found = found.select("doc_id", "text", *(F.when(on, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}_m") for k, (p, on) in wanted.items()))
    found = found.select("*", *(F.when(F.size(f"{k}_m") > 0, F.split(text, p, -1)).otherwise(none).alias(f"{k}_g") for k, (p, _) in wanted.items()))
    found = found.select("*", *(_places(F.col(f"{k}_g"), F.col(f"{k}_m")).alias(f"{k}_s") for k in wanted))

    def spans(number: int, kind: str) -> Column:
        whole = F.zip_with(F.col(f"{kind}_s"), F.col(f"{kind}_m"), lambda s, m: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), m.alias("value")))
        return F.filter(whole, lambda s: _valid(kind, s["value"]))

    base = F.transform(F.array_sort(F.concat(*(spans(i, k) for i, k in enumerate(KINDS)))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    lead = lambda v: F.length(F.regexp_extract(v, r"\A(?:[@._-]|\+(?![0-9(]))*", 0))
    tails = F.transform("mention_m", lambda m, i: F.struct(m.alias("m"), F.right(F.get("mention_g", i), F.lit(64)).alias("before")))

    def mention(s: Column, t: Column) -> Column:
        own = let(F.substring(t["m"], lead(t["m"]) + 1, F.length(t["m"])), lambda v: F.struct(F.lower(v).alias("value"), _whole(v).alias("seed")))
        return F.struct((s["start"] + lead(t["m"])).alias("start"), s["end"].alias("end"), own.alias("own"), t["before"].alias("before"))

    return found.select("doc_id", F.xxhash64("text").alias("mark"), base.alias("base"), F.zip_with("mention_s", tails, mention).alias("mentions"))


def _whole(value: Column) -> Column:
    """The kind whose rule takes the whole value, or null."""
    kind = F.lit(None).cast("int")
    # What kinds' values are made of. A card has 19 digits and 18 separators at most.
    shapes = (r"\A[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\z", r"\A[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++\z", r"\A[0-9](?:[\x20-]?[0-9]){13,18}\z", r"\A\+[0-9][\x20().0-9-]+[0-9]\z")
    for number, (name, shape) in reversed([*enumerate(zip(KINDS, shapes))]):
        fits = value.rlike(shape) & _valid(name, value)
        kind = F.when(F.length(value) <= 37, F.when(fits, number).otherwise(kind)).otherwise(kind) if name == "card" else F.when(fits, number).otherwise(kind)
    return kind


def _named(value: Column) -> Column:
    """A string as the graph has it: a number is its digits, unless points part them as an address's."""
    address = value.rlike(r"\A[0-9][0-9.]*+\z") & F.contains(value, F.lit(".")) & ~F.contains(value, F.lit("..")) & ~F.endswith(value, F.lit("."))
    return F.when(value.rlike(r"\A[+(]*+[0-9][\x20().0-9-]*+\z") & ~address, _digits(value)).otherwise(F.lower(value))


def discover(scanned: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, mark, start, end, kind): mentions that confident patterns mark and no base span touches."""
    each = scanned.where(F.size("mentions") > 0).select("doc_id", "mark", F.explode("mentions").alias("m"))
    each = each.select("doc_id", "mark", "m.start", "m.end", _named(F.col("m.own.value")).alias("value"), "m.before", F.col("m.own.seed").alias("seed"))
    ending = lambda n: F.lower(F.regexp_replace(F.regexp_extract("before", rf"(?:\S+\s+){{0,{n}}}\S*\z", 0), r"\s+", " "))
    patterns = F.array_distinct(F.array(F.concat(F.lit("1 "), ending(1)), F.concat(F.lit("2 "), ending(2))))
    pairs = materialize(each.withColumn("pattern", F.explode(patterns)).where(F.length(F.trim("pattern")) > 2).drop("before"), "mentions")
    edges = materialize(pairs.groupBy("pattern", "value").agg(F.min("seed").alias("seed")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("strings"))
    sure = edges.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct().withColumns({"score": F.lit(1.0), "sure": F.lit(1)})
    scores, best = sure, None
    for _ in range(rounds):
        sums = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.sum("sure").alias("seeds"))
        best = materialize(sums.join(sizes, "pattern").select("pattern", "kind", (F.col("score") / (F.col("strings") + 1)).alias("confidence"), "seeds"), "patterns")
        others = edges.select("pattern", "value").join(sure.select("value").distinct(), "value", "left_anti").join(best, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        scores = materialize(sure.union(others.select("value", "kind", "score", F.lit(0).alias("sure"))), "strings")
    strong = best.where((F.col("confidence") >= confidence) & (F.col("seeds") >= seeds))
    marked = pairs.where("seed is null").join(strong, "pattern").groupBy("doc_id", "mark", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("kind"))).alias("top"))
    marked = materialize(marked.select("doc_id", "mark", "start", "end", (-F.col("top.kind")).alias("kind")), "marked")
    if marked.isEmpty():
        return marked
    stretches = F.explode(F.sequence(F.expr(f"start div {STRETCH}"), F.expr(f"(end - 1) div {STRETCH}"))).alias("stretch")
    base = scanned.where(F.size("base") > 0).select("doc_id", "mark", F.explode("base").alias("s")).select("doc_id", "mark", "s.start", "s.end")
    base = base.select(F.col("doc_id").alias("of_doc"), F.col("mark").alias("of_mark"), F.col("start").alias("from"), F.col("end").alias("to"), stretches.alias("at"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("mark") == F.col("of_mark")) & (F.col("stretch") == F.col("at"))
    met = marked.select("doc_id", "mark", "start", "end", stretches).join(base, same & (F.col("from") < F.col("end")) & (F.col("to") > F.col("start")), "left_semi")
    met = met.select(*(F.col(c).alias(f"met_{c}") for c in ("doc_id", "mark", "start", "end"))).distinct()
    equal = F.col("doc_id").eqNullSafe(F.col("met_doc_id")) & (F.col("mark") == F.col("met_mark")) & (F.col("start") == F.col("met_start")) & (F.col("end") == F.col("met_end"))
    return marked.join(met, equal, "left_anti")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, base, spans) of every row: base spans, and all spans, as (start, kind, end) in order."""
    scanned = materialize(scan(docs, id_col, text_col), "scanned")
    more = discover(scanned).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    rows = scanned.select("doc_id", "mark", "base")
    joined = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    return joined.select("doc_id", "mark", "base", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans as [KIND] of its first. Its pieces are taken out of chunks of CHUNK
    characters, as a piece's place in a text is found by counting from the text's start."""
    name = lambda k: F.upper(F.element_at(F.array(*map(F.lit, KINDS)), k + 1))

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        part = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        across = F.concat(F.substring(part(i), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(part(j), F.lit(1), b % CHUNK))
        return F.when(i == j, F.substring(part(i), a % CHUNK + 1, b - a)).otherwise(across)

    def cut(chunks: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        runs = F.filter(F.zip_with(spans, ends, lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("from"))), lambda r: r["start"] >= r["from"])
        marks = F.transform(runs, lambda r: F.concat(piece(chunks, r["from"], r["start"]), F.lit("["), name(r["kind"]), F.lit("]")))
        return F.concat(F.array_join(marks, ""), piece(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), cut)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span, or run of spans that overlap, as [KIND] of its first; a null text stays null."""
    of_id, of_mark, spans = (unused(docs, n) for n in ("of_id", "of_mark", "of_spans"))
    found = find(docs, id_col, text_col).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark)).agg(F.first("spans").alias(spans))
    text = F.col(text_col)
    key = (F.col(id_col).cast("long").eqNullSafe(F.col(of_id))) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col(of_mark))
    return docs.join(found, key, "left").withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(_cut(text, F.col(spans)))).drop(of_id, of_mark, spans)
