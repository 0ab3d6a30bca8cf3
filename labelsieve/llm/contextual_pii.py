"""Personal data by patterns and by the company it keeps.

Base patterns find e-mail addresses, network addresses, card and telephone numbers. These seeds induce lexical patterns,
the one or two words before them; other tokens that hold digits or an at sign (@, [at], (at)) and follow such words are
candidates. Patterns and
candidate values form a bipartite graph whose scores are computed in turn: a pattern is as good as the share of its
values that are known or believed, a value is believed as far as its patterns are good. Patterns that end with high
confidence and enough distinct seeds mark further identifiers of a fitting shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.llm.columns import KEY, with_key
from labelsieve.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns. A run of a match's first class is tried from its first character, or from the
#: end of the match before: a later start would fail alike.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<!\S)(?:(?=\S*?(?:@|\[at\]|\(at\)))\S++|(?=[^\s0-9]*+[0-9])\S++(?:\x20[0-9(][0-9().-]*+(?!\S))*+)",
}
#: Texts without a match of these hold none of the kind.
NEEDS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda text: text.rlike(r"\+[0-9]"),
    "token": lambda text: text.rlike(r"[0-9@]|\[at\]|\(at\)"),
}
CONTEXT_CHARS = 48
ROUNDS = 3
LEAST_SEEDS = 5
CONFIDENCE = 0.8


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The check digit of a number of at most a few dozen digits."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weigh(place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        doubled = F.when(place % 2 == 0, digit * 2).otherwise(digit)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.transform(places, weigh), F.lit(0), lambda a, b: a + b) % 10 == 0


def is_valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern counts; matches of other kinds always do."""
    digits = digits_of(value)
    size = F.length(digits)
    parts = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", ""))
    in_range = F.forall(parts, lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")))
    return (
        F.when(kind == "ip", in_range)
        .when(kind == "card", F.when(size.between(16, 19), passes_luhn(digits)).otherwise(False))
        .when(kind == "phone", size.between(8, 15))
        .otherwise(True))


def all_matches(docs: DataFrame, text: str) -> DataFrame:
    """(key, kind, start, end, value, tail): matches of all kinds with their places in code points.

    The text is cut at the matches; running sums of the lengths of pieces and matches are the places. ``tail`` is the end
    of the piece before a match.
    """
    body = F.col(text)
    cut = [
        F.when(NEEDS[kind](body), F.struct(
            F.lit(kind).alias("kind"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("found"),
            F.split(body, pattern, -1).alias("pieces")))
        for kind, pattern in PATTERNS.items()]
    rows = docs.filter(NEEDS["token"](body)).select(*KEY, F.monotonically_increasing_id().alias("_row"), F.explode(F.array(*cut)).alias("c"))
    rows = rows.filter(F.size("c.found") > 0).select(*KEY, "_row", "c.kind", "c.found", "c.pieces")
    one = rows.select(*KEY, "_row", "kind", F.posexplode(F.arrays_zip("found", "pieces")).alias("at", "m")).filter("m.found IS NOT NULL")
    one = one.select(
        *KEY, "_row", "kind", "at", F.col("m.found").alias("value"), F.length("m.pieces").alias("gap"),
        F.length("m.found").alias("size"), F.substring("m.pieces", -CONTEXT_CHARS, CONTEXT_CHARS).alias("tail"))
    within = Window.partitionBy(*KEY, "_row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(within)
    placed = one.select(*KEY, "kind", (end - F.col("size")).cast("int").alias("start"), end.cast("int").alias("end"), "value", "tail")
    return placed.dropDuplicates([*KEY, "kind", "start"]).filter(is_valid(F.col("kind"), F.col("value")))


def contexts_of(tail: Column) -> Column:
    """The last word before a match, and the last two."""
    tail = F.lower(tail)
    one = F.regexp_extract(tail, r"(?<!\S)(\S++)\s*+$", 1)
    two = F.regexp_extract(tail, r"(?<!\S)(\S++\s++\S++)\s*+$", 1)
    return F.array_remove(F.array_distinct(F.array(one, two)), "")


def fits(kind: Column, value: Column) -> Column:
    """Whether a token has the shape of an identifier of a kind."""
    size = F.length(digits_of(value))
    return (
        F.when(kind == "email", value.rlike(r"[A-Za-z0-9]\S*(?:@|\[at\]|\(at\))\S*[A-Za-z0-9]"))
        .when(kind == "ip", value.rlike(r"^\[?[0-9A-Fa-f]{1,4}(?:[.:]+[0-9A-Fa-f]{1,4}){3,7}\]?$"))
        .when(kind == "card", size.between(12, 19) & value.rlike(r"^[0-9 .-]+$"))
        .when(kind == "phone", size.between(7, 15) & value.rlike(r"^[(]?[0-9][0-9 ().-]+[0-9]$"))
        .otherwise(False))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9]+$", "")


def discover(matches: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """(key, kind, start, end) of identifiers that the base patterns miss."""
    base = matches.filter(F.col("kind") != "token")
    seeds = base.select("kind", F.lower("value").alias("value"), F.explode(contexts_of(F.col("tail"))).alias("context"))
    patterns = materialize(
        seeds.groupBy("kind", "context", "value").agg(F.count("*").alias("n")).groupBy("kind", "context")
        .agg(F.count("*").alias("seeds"), F.sum("n").alias("seen")).filter(F.col("seeds") >= least_seeds))
    taken = base.select(*KEY, F.col("start").alias("_start"), F.col("end").alias("_end"))
    tokens = matches.filter(F.col("kind") == "token").drop("kind")
    overlaps = [tokens[k] == taken[k] for k in KEY] + [tokens["start"] < taken["_end"], taken["_start"] < tokens["end"]]
    free = tokens.join(taken, overlaps, "left_anti").withColumn("value", trimmed(F.col("value")))
    follow = materialize(
        free.select(*KEY, "start", "value", F.explode(contexts_of(F.col("tail"))).alias("context"))
        .join(patterns.select("kind", "context"), "context"))
    edges = materialize(
        follow.withColumn("fits", fits(F.col("kind"), F.col("value"))).groupBy("kind", "context", F.lower("value").alias("value"), "fits")
        .agg(F.count("*").alias("n")))
    believed = edges.select("kind", "value").distinct().withColumn("belief", F.lit(0.0))
    scored = None
    for _ in range(rounds):
        others = edges.join(believed, ["kind", "value"]).groupBy("kind", "context").agg(
            F.sum("n").alias("others"), F.sum(F.col("n") * F.when(F.col("fits"), F.col("belief")).otherwise(0.0)).alias("mass"))
        scored = materialize(
            patterns.join(others, ["kind", "context"], "left").select(
                "kind", "context",
                ((F.col("seen") + F.coalesce("mass", F.lit(0.0))) / (F.col("seen") + F.coalesce("others", F.lit(0)) + 1)).alias("score")))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))
        believed = edges.filter("fits").join(scored, ["kind", "context"]).groupBy("kind", "value").agg((1 - doubt).alias("belief"))
        believed = edges.select("kind", "value").distinct().join(believed, ["kind", "value"], "left").fillna(0.0, ["belief"])
    good = scored.filter(F.col("score") >= confidence)
    found = follow.filter(fits(F.col("kind"), F.col("value"))).join(good, ["kind", "context"])
    best = found.groupBy(*KEY, "start", "value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return best.select(*KEY, "kind", "start", (F.col("start") + F.length("value")).cast("int").alias("end"))


def find_spans(docs: DataFrame, text: str, identity: tuple[str, ...]) -> DataFrame:
    """(key, base, spans): arrays of (rank, start, end, kind) in the order of kinds and places, ``spans`` with what the
    method adds. Texts without any have no row; null and empty texts have none. ``identity`` must determine the text; rows
    that repeat it share a row. Places are code points, the end is exclusive.
    """
    matches = materialize(all_matches(with_key(docs, *identity), text))
    base = matches.filter(F.col("kind") != "token").select(*KEY, "kind", "start", "end", F.lit(True).alias("base"))
    spans = base.unionByName(discover(matches).withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(kind) for kind in KINDS]), F.col("kind")).cast("int")
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    return spans.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("spans"))


def with_spans(docs: DataFrame, text: str, identity: tuple[str, ...]) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, empty where nothing was found; columns of these names are replaced."""
    rows = with_key(docs.drop(*[c for c in ("base", "spans") if c not in identity and c != text]), *identity)
    joined = rows.join(find_spans(docs, text, identity), KEY, "left").drop(*KEY)
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
    return joined.withColumns({name: F.coalesce(name, none) for name in ("base", "spans")})


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch covered by spans replaced by the upper-case kind of its first span, in brackets."""
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))

    def step(state: Column, span: Column) -> Column:
        end = -span["until"]
        gap = F.substring(text, state["done"] + 1, span["start"] - state["done"])
        fresh = F.concat(state["out"], gap, F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(
            F.when(span["start"] >= state["done"], fresh).otherwise(state["out"]).alias("out"),
            F.greatest(state["done"], end).alias("done"))

    whole = F.aggregate(
        places, start, step, lambda state: F.concat(state["out"], F.substring(text, state["done"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
