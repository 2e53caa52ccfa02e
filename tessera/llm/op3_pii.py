"""Personal data: patterns find entities, and corpus co-occurrence finds the terms that give them away. Native.

Base spans are the matches of four patterns; a fifth finds secrets, long runs of letters mixed with digits. Each match is a
protected entity. The corpus says how strongly a term near an entity reveals it: with N documents, df(e) holding the entity,
df(t) the term and df(e, t) the term near the entity, PMI(e; t) = log2(N df(e, t) / (df(e) df(t))), and the entity's information
is IC(e) = log2(N / df(e)). A term that carries at least `share` of that information discloses the entity, in however few
documents the entity is: its occurrences near the entity become spans of kind "term". `sanitised` gives the texts with every
span generalised to its kind. As PMI = IC + log2(df(e, t) / df(t)), what counts for an entity in one document is how rare the
term is in the whole corpus; callers may ask for more evidence with `support`. Near is: whole words within REACH code points,
with no other entity of the same kind between.

All counts come from all documents and are made by sums that combine before they are shuffled, so an entity or a term that
a third of all documents hold is a short row per task. Texts without entities are not shuffled. Positions are code points, the
end exclusive; they are sums of lengths made in two levels, so that a text of n matches costs n * sqrt(n) short steps at most,
and each gap between matches is read a fixed number of times: long texts of nothing but addresses are no special case.

Defined results. Null and empty texts have no spans. Rows that repeat are documents of their own, and count as such. An
empty table gives an empty result. Other columns are ignored. Overlapping spans of different kinds are all listed, and of
overlapping ones `sanitised` replaces the first (at the same place: of the kind listed first). Terms with equal scores are all
taken: nothing is ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: The patterns, so written that a search tries each run of characters once: a match begins where its run does (or where
#: the match before it ended), and runs are taken whole, never given back. A card's run has 16 to 19 digits in all, as no
#: others can pass.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+",
}
#: What a text must hold for its kind to be searched at all.
NEEDS = {"email": "@", "phone": "+"}
#: Terms: words of three letters or more, at most `REACH` code points before or after an entity. Words that the reach's
#: border cuts are left out: contexts are given with a character more, or a blank where the gap itself ends.
TERM, REACH = r"\p{L}{3,}", 120
BEFORE, AFTER = r"(?<=\P{L})\p{L}{3,}+", r"\p{L}{3,}+(?=\P{L})"
SHARE, SUPPORT = 0.9, 1
#: Matches whose lengths are summed in one step of the lower level.
GROUP = 128

_SPAN = "array<struct<start:int,end:int,value:string>>"
_SEEN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(lengths: Column) -> Column:
    """Running sums of an array of lengths, the own length included."""
    add = lambda a, b: a + b
    total = lambda part: F.aggregate(part, F.lit(0), add)
    groups = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / GROUP).cast("int")), lambda g: total(F.slice(v, g * GROUP + 1, F.lit(GROUP))))
    first = lambda sums: F.transform(sums, lambda _, g: total(F.slice(sums, F.lit(1), g)))
    own = lambda v, firsts: F.transform(v, lambda _, i: F.get(firsts, F.floor(i / GROUP).cast("int")) + total(F.slice(v, i - i % GROUP + 1, i % GROUP + 1)))
    return _let(lengths, lambda v: _let(_let(groups(v), first), lambda firsts: own(v, firsts)))


def _placed(pair: Column) -> Column:
    """array<start, end, value, before, after> from the matches and the gaps of a text that is split at them."""
    n = F.size(pair["found"])
    pieces = F.arrays_zip(F.slice(pair["gaps"], F.lit(1), n).alias("gap"), pair["found"].alias("value"), F.slice(pair["gaps"], F.lit(2), n).alias("following"))

    def one(p: Column, end: Column) -> Column:
        before = F.when(F.length(p["gap"]) > REACH, F.right(p["gap"], F.lit(REACH + 1))).otherwise(F.concat(F.lit(" "), p["gap"]))
        after = F.when(F.length(p["following"]) > REACH, F.substring(p["following"], 1, REACH + 1)).otherwise(F.concat(p["following"], F.lit(" ")))
        return F.struct((end - F.length(p["value"])).cast("int").alias("start"), end.cast("int").alias("end"), p["value"].alias("value"), before.alias("before"), after.alias("after"))

    placed = lambda ps: _let(_ends(F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["value"]))), lambda ends: F.zip_with(ps, ends, one))
    return F.when(n == 0, F.expr(f"cast(array() as {_SEEN})")).otherwise(_let(pieces, placed))


def located(rows: DataFrame) -> DataFrame:
    """The rows with an array<start, end, value, before, after> for each kind: what passes of its pattern's leftmost matches."""
    none = F.expr("cast(array() as array<string>)")
    search = lambda k: F.regexp_extract_all("text", F.lit(PATTERN[k]), F.lit(0))
    matched = rows.select("*", *((F.when(F.contains("text", F.lit(NEEDS[k])), search(k)).otherwise(none) if k in NEEDS else search(k)).alias(f"_{k}") for k in KINDS))
    pairs = F.array(*(F.struct(F.col(f"_{k}").alias("found"), F.when(F.size(f"_{k}") == 0, none).otherwise(F.split("text", PATTERN[k], -1)).alias("gaps")) for k in KINDS))
    placed = matched.select(*rows.columns, F.transform(pairs, _placed).alias("_placed"))
    test = {k: _passes(k) for k in KINDS}
    spans = {k: F.get("_placed", F.lit(i)) for i, k in enumerate(KINDS)}
    return placed.select(*rows.columns, *((F.filter(spans[k], test[k]) if test[k] else spans[k]).alias(k) for k in KINDS))


def _words(window: Column, pattern: str, at: Column) -> Column:
    """array<start, end, value> of the small-letter words of a short window that begins at `at`."""
    none = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        one = F.array(F.struct((at + start).cast("int").alias("start"), (at + end).cast("int").alias("end"), F.lower(pair["value"]).alias("value")))
        return F.struct(end.alias("at"), F.concat(state["out"], one).alias("out"))

    found, gaps = F.regexp_extract_all(window, F.lit(pattern), F.lit(0)), F.split(window, pattern, -1)
    return F.aggregate(F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda p: p["value"].isNotNull()), none, add, lambda state: state["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    backward = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(backward, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str):
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))  # noqa: E731  leading zeros don't count, and long numbers don't fit an int
        return lambda s: F.forall(F.split(s["value"], r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return lambda s: luhn(_digits(s["value"]))
    if kind == "phone":
        return lambda s: F.length(_digits(s["value"])).between(8, 15)
    if kind == "secret":
        return lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    return None


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _around() -> Column:
    """array<entity, terms> of all kinds' spans: an entity is a kind and a value, its terms are array<start, end, value>."""
    of = lambda k: F.transform(F.col(k), lambda s: F.struct(F.concat(F.lit(f"{k}:"), F.lower(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["before"].alias("before"), s["after"].alias("after")))
    terms = lambda s: F.concat(_words(s["before"], BEFORE, s["start"] - F.length(s["before"])), _words(s["after"], AFTER, s["end"]))
    return F.transform(F.concat(*map(of, KINDS)), lambda s: F.struct(s["entity"].alias("entity"), terms(s).alias("terms")))


def find(docs: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """doc_id, text and an array of spans (start, end, value) a kind: the base kinds, secret and term."""
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    held = Written(located(texts).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *(_bare(F.col(k)).alias(k) for k in KINDS), _around().alias("around")), "pii")

    total = held.df.count()
    rows = held.df.where(F.size("around") > 0)
    near = rows.select("row", F.explode("around").alias("a")).select("row", "a.entity", F.explode("a.terms").alias("t"))
    near = near.select("row", "entity", F.col("t.value").alias("term"), F.col("t").alias("span"))
    of_entity = rows.select(F.explode(F.array_distinct(F.col("around.entity"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("df_e"))
    of_pair = near.select("row", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("df_et")).where(F.col("df_et") >= support)
    # Document frequencies of all words of all texts, by hash: 8 bytes a word in the shuffle, whatever the words are.
    word = held.df.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))).alias("h"))
    of_term = word.groupBy("h").agg(F.count("*").alias("df_t")).where(F.col("df_t") >= support)
    scored = of_pair.join(of_entity, "entity").withColumn("h", F.xxhash64("term")).join(of_term, "h")
    pmi = F.log2(F.lit(float(total)) * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    telling = scored.where((F.col("df_e") < total) & (pmi >= share * F.log2(F.lit(float(total)) / F.col("df_e")))).select("entity", "term")
    added = near.join(telling, ["entity", "term"]).groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("term"))
    none = F.expr(f"cast(array() as {_SPAN})")
    told = rows.drop("around").join(added, "row", "left").withColumn("term", F.coalesce("term", none)).drop("row")
    plain = held.df.where(F.size("around") == 0).drop("row", "around").withColumn("term", none)
    return told.unionByName(plain)


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span (array<start, end, kind>, sorted by start) replaced by its kind in brackets; of overlapping spans the first counts.

    The text is cut at every GROUP-th span's start, and each piece at its own spans, so a span costs the length of its piece.
    """
    size = lambda: F.size(spans)
    cut = lambda g: F.coalesce(F.get(spans, (g + 1) * GROUP)["start"], F.length(text))
    start = F.struct(F.lit(0).alias("base"), F.lit(0).alias("at"), text.alias("rest"), F.expr("cast(array() as array<string>)").alias("out"))

    def span(piece: Column, base: Column):
        def add(state: Column, s: Column) -> Column:
            more = F.concat(state["out"], F.substring(piece, state["at"] - base + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            taken = s["start"] >= state["at"]
            return F.struct(F.when(taken, s["end"]).otherwise(state["at"]).alias("at"), F.when(taken, more).otherwise(state["out"]).alias("out"))

        return add

    def group(state: Column, g: Column) -> Column:
        def done(piece: Column, inner: Column) -> Column:
            left = F.when(inner["at"] < cut(g), F.substring(piece, inner["at"] - state["base"] + 1, F.length(piece))).otherwise("")
            return F.struct(
                cut(g).alias("base"), F.greatest(inner["at"], cut(g)).alias("at"), F.substring(state["rest"], F.length(piece) + 1, F.length(state["rest"])).alias("rest"),
                F.concat(state["out"], F.array(F.concat(inner["out"], left))).alias("out"),
            )

        first = F.struct(state["at"].alias("at"), F.lit("").alias("out"))
        walk = lambda piece: F.aggregate(F.slice(spans, g * GROUP + 1, F.lit(GROUP)), first, span(piece, state["base"]))
        return _let(F.substring(state["rest"], F.lit(1), cut(g) - state["base"]), lambda piece: _let(walk(piece), lambda inner: done(piece, inner)))

    groups = F.sequence(F.lit(0), F.floor((size() - 1) / GROUP).cast("int"))
    return F.when(size() == 0, text).otherwise(F.aggregate(groups, start, group, lambda state: F.concat(F.array_join(state["out"], ""), state["rest"])))


def _every() -> Column:
    """All spans of a row of `find` as array<start, order, end, kind>, sorted."""
    of = lambda k, n: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("order"), s["end"].alias("end"), F.lit(k).alias("kind")))
    return F.array_sort(F.concat(*(of(k, n) for n, k in enumerate((*KINDS, "term")))))


def sanitised(found: DataFrame) -> DataFrame:
    """The rows of `find` with `clean`, the text in which every span is generalised to its kind."""
    return found.withColumn("_spans", _every()).withColumn("clean", sanitise(F.col("text"), F.col("_spans"))).drop("_spans")


def digest(docs: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """Counts, the digest of the base spans, all spans, and the digest of the sanitised text, for every row."""
    found = sanitised(find(docs, share, support))
    base = F.array_join(F.concat(*(_listed(F.col(k), k) for k in BASE)), ",")
    every = F.array_join(F.concat(*(_listed(F.col(k), k) for k in (*KINDS, "term"))), ",")
    n = {k: F.size(k).cast("bigint") for k in (*KINDS, "term")}
    return found.select(
        "doc_id", *(n[k].alias(f"n_{k}") for k in BASE), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), n["secret"].alias("n_secret"), n["term"].alias("n_term"),
        sum((n[k] for k in KINDS[1:]), n[KINDS[0]]).alias("n_private"), F.sha2("clean", 256).alias("clean_sha256"),
    )
