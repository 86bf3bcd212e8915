r"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts and benchmark items are canonicalised alike: numbers, names and units become typed placeholders, the
rest is lower-cased and freed of punctuation at word ends.  Windows of ``n`` template words are hashed and
joined, so a question with other numbers or names still meets its template.  Windows on one diagonal (the
same offset between text and item) belong to one occurrence; so do those on diagonals that follow each other
by at most half an item's length, where words were put in or left out.  An occurrence counts if it covers
``min_share`` of the item's windows, or ``min_run`` of them in a row on one diagonal, and its slots are
consistent: one item value always stands for one value of the text (of which a longer run of names may be a
part).  Diagonals count together and each by itself.

A name is a run of capitalised words (not all in capitals, and not in ``COMMON``), also where a sentence
begins; the run is one word of the template.  A unit is a word of ``UNITS`` after a number.  Windows with
fewer than ``min_literals`` words that are no placeholder say too little and are left out.

The benchmark's windows are broadcast if they are at most ``broadcast_rows`` (they are counted), else both
sides are shuffled by window hash.

Defined results: null and empty texts and items with less than a window have no match.  A repeated item or
document id gives one row per pair.  Rows with a null id are never reported and never dropped.  Extra
columns, also of the same name on both sides, are ignored by ``contaminated`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import without_ids
from .runs import stage

#: Own choice of common units, as they follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs ms hz kw kwh w v a n j k c f usd eur gbp"
UNITS += " meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres seconds minutes"
UNITS += " hours days weeks months years degrees percent dollars euros cents"

#: Words that are no names where they begin a sentence.
COMMON = "a about after all also an and any are as at be because before both but by can could did do does during each every"
COMMON += " few find first for from given had has have he her here his how if in into is it its let many may more most much"
COMMON += " must my no not now of on once one only or other our she should since so some such than that the their them then"
COMMON += " there these they this those though through to two under until was we were what when where which while who whom"
COMMON += " whose why will with within would yet you your"

_SLOT = "\u0001"
#: Between the words of one name.
_JOIN = "\u0002"
# the look at one character first keeps the costly looks around it from every other place
_NUMBER = r"(?=[+\-$€£(0-9])(?<!\S)[+\-$€£(]*[0-9][0-9.,:/]*[%°)]*[.,;:!?]*(?!\S)"
_UNIT = rf"(?<={_SLOT}num )(?i:{'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])"
_NAME_WORD = rf"(?=\p{{Lu}}[\p{{Ll}}'’-])(?<![\p{{L}}\p{{N}}'’-])(?!(?i:{'|'.join(COMMON.split())})(?![\p{{L}}\p{{N}}'’-]))[\p{{L}}\p{{N}}'’-]++"
_NAME = rf"{_NAME_WORD}(?:{_JOIN}{_NAME_WORD})*+"
_NAME_GAP = rf"({_NAME_WORD})[ \t]++(?={_NAME_WORD})"
_PUNCT = r"!-/:-@\[-`{-~"
_ENDS = rf"(?=[{_PUNCT}])(?:(?<=[^\s{_PUNCT}])[{_PUNCT}]++(?!\S)|(?<!\S)[{_PUNCT}]++(?=[^\s{_PUNCT}]))"


def _words(text: Column) -> Column:
    """Words in order, without the empty strings that blanks at the ends leave."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def joined_names(text: Column) -> Column:
    """``text`` with U+0002 between the words of a name, so that a name is one word; it holds no U+0001."""
    marked = text.contains(_SLOT) | text.contains(_JOIN)
    return F.regexp_replace(F.when(marked, F.translate(text, _SLOT + _JOIN, "  ")).otherwise(text), _NAME_GAP, f"$1{_JOIN}")


def template(text: Column) -> Column:
    """The template words of a text of ``joined_names``, as many as it has words; placeholders begin with U+0001."""
    text = F.regexp_replace(text, _NUMBER, f"{_SLOT}num")
    text = F.regexp_replace(text, _UNIT, f"{_SLOT}unit")
    text = F.regexp_replace(text, _NAME, f"{_SLOT}name")
    return _words(F.lower(F.regexp_replace(text, _ENDS, "")))


def _windows(frame: DataFrame, n: int) -> DataFrame:
    """Columns ``id, words, codes`` become one row per window: its place and hash.  ``words`` only goes along."""
    last = F.size("codes") - n
    hashes = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(F.col("codes"), i + k) for k in range(n)]),
    )
    return frame.select("id", "words", F.posexplode(hashes).alias("at", "window"))


def _consistent(slots: Column) -> Column:
    """Whether no item value stands for two text values, but for a run of names that goes on at one end."""

    def longer(a: Column, b: Column) -> Column:
        return a.startswith(F.concat(b, F.lit(_JOIN))) | a.endswith(F.concat(F.lit(_JOIN), b))

    def agree(s: Column, t: Column) -> Column:
        a, b = s["text"], t["text"]
        return (s["item"] != t["item"]) | (a == b) | longer(a, b) | longer(b, a)

    single = F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda s: s["item"])))
    return single | F.forall(slots, lambda s: F.forall(slots, lambda t: agree(s, t)))


def _prepared(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # nulls go by the columns themselves: a filter on what is made of a text would make it twice
    there = frame.filter(frame[id_col].isNotNull() & frame[text_col].isNotNull())
    return there.select(there[id_col].alias("id"), joined_names(there[text_col]).alias("text"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 8,
    min_share: float = 0.5,
    min_literals: int = 4,
    min_run: int = 13,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """``id, item_id, n_matched, n_windows``: the items whose template each document holds."""
    items = _prepared(benchmark, item_id_col, item_text_col).withColumn("tokens", template(F.col("text")))
    items = items.select("id", _words(F.col("text")).alias("words"), "tokens", F.transform("tokens", lambda t: F.xxhash64(t)).alias("codes"))
    literal = F.size(F.filter(F.slice("tokens", F.col("at") + 1, n), lambda t: ~t.startswith(_SLOT)))
    # tokens are wanted again per window, so they travel as "words" beside the values
    both = items.select("id", F.struct("words", "tokens").alias("words"), "codes")
    wanted = (
        _windows(both, n)
        .select("id", "words.*", "at", "window")
        .filter(literal >= min_literals)
        .select(
            F.col("id").alias("item_id"),
            F.col("at").alias("item_at"),
            F.dense_rank().over(Window.partitionBy("id").orderBy("at")).alias("item_rank"),
            F.size("tokens").alias("item_size"),
            "window",
            F.slice("words", F.col("at") + 1, n).alias("item_words"),
            F.slice("tokens", F.col("at") + 1, n).alias("item_tokens"),
        )
    )
    sizes = wanted.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"))
    if wanted.count() <= broadcast_rows:
        wanted, sizes = F.broadcast(wanted), F.broadcast(sizes)
    texts = _prepared(docs, id_col, text_col)
    # the words themselves are wanted for windows that meet one, which are few
    texts = texts.select("id", F.col("text").alias("words"), F.transform(template(F.col("text")), lambda t: F.xxhash64(t)).alias("codes"))
    slots = F.filter(
        F.arrays_zip(
            F.col("item_tokens").alias("token"), F.col("item_words").alias("item"), F.slice(_words(F.col("words")), F.col("at") + 1, n).alias("text")
        ),
        lambda s: s["token"].startswith(_SLOT),
    )
    met = _windows(texts, n).join(wanted, "window").select(
        "id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_rank", "item_size", slots.alias("slots")
    )
    together = [F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("ranks", "slots")]
    single = met.groupBy("id", "item_id", "diagonal").agg(
        F.array_sort(F.collect_set("item_rank")).alias("ranks"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        F.max("item_size").alias("item_size"),
    )
    # some rows a leak; both uses below would read all texts
    single = stage(single, "diagonals")
    # diagonals that follow each other closely
    along = Window.partitionBy("id", "item_id").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > F.greatest(F.col("item_size") / 2, F.lit(n))
    near = single.withColumn("far", F.coalesce(far, F.lit(True)).cast("bigint")).withColumn("cluster", F.sum("far").over(along))
    near = near.groupBy("id", "item_id", "cluster").agg(*together, F.count(F.lit(1)).alias("diagonals")).filter("diagonals > 1")
    last = F.size("ranks") - min_run
    steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    in_a_row = F.exists(steps, lambda i: F.get("ranks", i + (min_run - 1)) - F.get("ranks", i) == min_run - 1)
    occurrences = single.select("id", "item_id", "ranks", "slots", in_a_row.alias("run"))
    occurrences = occurrences.unionByName(near.select("id", "item_id", "ranks", "slots", F.lit(False).alias("run")))
    return (
        occurrences.withColumn("n_matched", F.size("ranks").cast("bigint"))
        .join(sizes, "item_id")
        .filter(F.col("run") | (F.col("n_matched") >= min_share * F.col("n_windows")))
        .filter(_consistent(F.col("slots")))
        .groupBy("id", "item_id")
        .agg(F.max("n_matched").alias("n_matched"), F.max("n_windows").alias("n_windows"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    return without_ids(docs, id_col, contaminated(docs, benchmark, id_col, text_col, **options).select("id"))
