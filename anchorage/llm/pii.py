r"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card and phone numbers.  Which other terms reveal
them is estimated from the corpus: with N documents, of which n_e hold entity e, n_t hold term t and n_te
hold both, anywhere, t tells PMI = log2(n_te N / (n_t n_e)) bits of the IC = log2(N / n_e) bits that e
carries.  In documents that hold e, terms with PMI / IC of ``GENERALISE`` or more are generalised wherever
they stand, and from ``REMOVE`` on removed.  Documents are counted by text, so copies of a text prove no more
than the text does.

A ratio of few counts proves little, so the share n_te / n_t that enters PMI is the lower end of its Wilson
interval at ``ERRORS`` standard errors.  Where no more than ``FEW`` texts hold both, nothing is left to estimate:
the plain share counts, but a text loses such a term only if the term stands in it with a capital within
``NEAR`` code points of an entity.  Then it goes wherever it stands in that text.

Entities that the same documents hold have the same counts with every term, and so have such terms; so
pairs are counted between classes of both, which are told apart by two 64-bit hashes of their documents.

Offsets are code points, ends exclusive.  Matches of a kind are leftmost and do not overlap; kinds may.
Terms (three letters or more, any case) that overlap an entity are left to it.

Defined results: a null text is empty and has no spans.  Rows with the same id but different texts are
different documents; rows with a null id have entities but are not counted and get no added spans.  Extra
columns are ignored by ``find_personal_data`` and kept by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from .runs import stage


KINDS = ["email", "ip", "card", "phone", "term"]
GENERALISE = 0.8
REMOVE = 0.95
ERRORS = 1.0
FEW = 2
NEAR = 64

# Equal to the plain patterns, but every run of characters is entered once, where it begins, so they are linear
# and possessive.  An address may also begin where the one before it ended (\G).
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A run of 14 to 19 digits with single separators; shorter and longer runs are no cards.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"\p{L}{3,}+"


_SPAN = "struct<start:int,kind:int,end:int,value:string>"
_BLOCK = 128


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches as (start, kind, end, value): what the pattern splits off tells where the matches are.

    Places are running sums, taken within blocks of matches and over the blocks: arrays that grow by one
    element are copied each time, so a single pass over very many matches would be quadratic.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("value"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["value"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(i: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(F.slice(pairs, i * _BLOCK + 1, _BLOCK), empty, step)

    def place(acc: Column, b: Column) -> Column:
        moved = F.struct(acc["at"].alias("at"), b["out"].alias("out"))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["blocks"], F.array(moved)).alias("blocks"))

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(found) - 1) / _BLOCK).cast("int")), block)
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:array<{_SPAN}>>>").alias("blocks"))
    placed = F.aggregate(blocks, none, place, lambda acc: acc["blocks"])

    def moved(b: Column) -> Column:
        return F.transform(
            b["out"],
            lambda s: F.struct((s["start"] + b["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + b["at"]).alias("end"), s["value"].alias("value")),
        )

    return F.when(F.size(found) > 0, F.flatten(F.transform(placed, moved))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.cast("int"))
    weighed = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(weighed, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def _ip_parts(value: Column) -> Column:
    short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: F.when(F.char_length(p) > 3, False).otherwise(p.cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """The entities of ``text``, ordered by start and kind."""
    n_digits = lambda s: F.char_length(_digits(s["value"]))
    kinds = [
        F.when(text.contains("@"), _spans(text, _EMAIL, 0)),
        F.filter(_spans(text, _IP, 1), lambda s: _ip_parts(s["value"])),
        F.filter(_spans(text, _CARD, 2), lambda s: _luhn(s["value"])),
        F.when(text.contains("+"), F.filter(_spans(text, _PHONE, 3), lambda s: n_digits(s).between(10, 15))),
    ]
    none = F.array().cast(f"array<{_SPAN}>")
    return F.array_sort(F.concat(*[F.coalesce(k, none) for k in kinds]))


def _classes(rows: DataFrame, key: str, n: str, one: str, two: str) -> DataFrame:
    """Each ``key`` with the number of its documents, and their hashes."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias(n),
        F.bit_xor(F.xxhash64("uid")).alias(one),
        F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias(two),
    )


def _share(n_both: Column, n_t: Column) -> Column:
    """n_both / n_t, or for more than ``FEW`` the lower end of its Wilson interval."""
    share, z2 = n_both / n_t, ERRORS**2
    spread = F.sqrt(share * (1 - share) / n_t + z2 / (4 * n_t * n_t))
    return F.when(n_both <= FEW, share).otherwise((share + z2 / (2 * n_t) - ERRORS * spread) / (1 + z2 / n_t))


def _revealing(holding: DataFrame, terms: DataFrame, total: float) -> DataFrame:
    """``uid, term, action, action_near``: the terms of each of the documents ``holding`` entities that reveal one.

    ``action`` is what many texts prove, ``action_near`` what few texts do if the term is near an entity.
    ``terms`` has the terms of all documents, ``total`` is their number.
    """
    entity = F.transform("spans", lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"])))
    entities = holding.select("uid", F.explode(F.array_distinct(entity)).alias("entity"))
    n_entity = stage(_classes(entities, "entity", "n_e", "e1", "e2"), "entity_classes")
    most = n_entity.agg(F.max("n_e")).first()[0] or 0

    # PMI / IC >= GENERALISE needs n_t <= N ^ (1 - GENERALISE) * n_e ^ GENERALISE, since n_te <= n_e
    def may_tell(n_e: Column) -> Column:
        return F.col("n_t") <= F.pow(F.lit(total), F.lit(1 - GENERALISE)) * F.pow(n_e.cast("double"), F.lit(GENERALISE)) * 1.000001

    at = holding.select("uid", F.explode("terms").alias("term"))
    n_term = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter(may_tell(F.lit(most)))
    n_term = stage(n_term.join(_classes(at, "term", "n_held", "t1", "t2"), "term"), "term_classes")
    at = spread_join(at, n_term.drop("n_held"), ["term"], n_term, "n_held", ["uid"]).filter(F.col("n_t").isNotNull())
    at = stage(at, "terms")
    held = spread_join(entities, n_entity, ["entity"], n_entity, "n_e", ["uid"]).select("uid", "n_e", "e1", "e2").distinct()
    pair = ["n_e", "e1", "e2", "n_t", "t1", "t2"]
    pairs = held.join(at.select("uid", "n_t", "t1", "t2").distinct(), "uid").filter(may_tell(F.col("n_e")))
    pairs = stage(pairs.select("uid", *pair), "pairs")
    information = F.log2(F.lit(total) / F.col("n_e"))
    told = F.log2(_share(F.col("n_both"), F.col("n_t")) * total / F.col("n_e"))
    disclosed = F.when(information > 0, told / information).otherwise(F.lit(0.0))
    telling = (
        pairs.groupBy(*pair)
        .agg(F.count(F.lit(1)).alias("n_both"))
        .withColumn("disclosed", F.round(disclosed, 9))
        .filter(F.col("disclosed") >= GENERALISE)
        .select(
            *pair, "n_both", (F.col("n_both") <= FEW).alias("few"),
            F.when(F.col("disclosed") >= REMOVE, "remove").otherwise("generalise").alias("action"),
        )
    )
    telling = stage(telling, "telling")
    met = spread_join(pairs, telling.drop("n_both"), pair, telling, "n_both", ["uid"]).filter(F.col("action").isNotNull())
    # "remove" comes after "generalise"
    met = met.groupBy("uid", "t1", "t2").agg(
        F.max(F.when(~F.col("few"), F.col("action"))).alias("action"), F.max(F.when(F.col("few"), F.col("action"))).alias("action_near")
    )
    return at.join(met, ["uid", "t1", "t2"]).select("uid", "term", "action", "action_near")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000
) -> DataFrame:
    """``id, spans, added`` per row of ``docs``: spans of entities, and of the terms that reveal them.

    A span is (start, kind, end, value), kinds as in KINDS; of an added one the value is its action,
    ``generalise`` or ``remove``.  The numbers of rows that are copies are broadcast if they are at most
    ``broadcast_rows`` (they are counted), else texts are shuffled to leave copies out.
    """
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    terms = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), lambda t: F.lower(t)))
    found = texts.withColumn("spans", base_spans(F.col("text"))).select(
        F.monotonically_increasing_id().alias("uid"),  # staged, so it stays
        "id",
        F.xxhash64("text").alias("d1"),
        F.xxhash64(F.lit(1), "text").alias("d2"),
        "spans",
        F.when(F.col("id").isNotNull(), terms).alias("terms"),
        F.when(F.size("spans") > 0, F.col("text")).alias("text"),
    )
    found = stage(found, "entities")
    known = found.filter(F.col("id").isNotNull())
    copies = known.groupBy("d1", "d2").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies"))
    copies = stage(copies, "copies")
    total = copies.count()
    # every text once; of the rows left out only the numbers are moved, unless they are very many
    spare = known.select("uid", "d1", "d2").join(copies.filter("copies > 1").select("d1", "d2", F.col("uid").alias("first")), ["d1", "d2"])
    spare = stage(spare.filter(F.col("uid") != F.col("first")).select("uid"), "spare")
    if spare.count() <= broadcast_rows:
        spare = F.broadcast(spare)
    single = known.join(spare, "uid", "left_anti")
    holding = stage(single.filter(F.size("spans") > 0).select("uid", "spans", "terms", "text"), "holding")
    revealing = stage(_revealing(holding, single.select(F.explode("terms").alias("term")), max(float(total), 1.0)), "revealing")

    # words of the revealed terms and entities in one row of places, to leave out words that overlap an entity
    holding = holding.join(revealing.select("uid").distinct(), "uid", "left_semi")
    words = holding.select("uid", F.explode(_spans(F.col("text"), _TERM, len(KINDS) - 1)).alias("s"))
    words = words.select(
        "uid", F.lower("s.value").alias("term"), "s.start", "s.end", F.col("s.value").rlike(r"^\p{Lu}").alias("capital")
    ).join(revealing, ["uid", "term"])
    entities = holding.select("uid", F.explode("spans").alias("s")).select("uid", "s.start", "s.end")
    places = words.unionByName(entities, allowMissingColumns=True)
    upto = Window.partitionBy("uid").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_entity = F.col("term").isNull()
    places = places.withColumn("before", F.max(F.when(is_entity, F.col("end"))).over(upto.orderBy("start")))
    places = places.withColumn("after", F.min(F.when(is_entity, F.col("start"))).over(upto.orderBy(F.desc("start"))))
    apart = ~is_entity & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))
    close = (F.col("start") - F.col("before") <= NEAR) | (F.col("after") - F.col("end") <= NEAR)
    near = F.coalesce(F.max(apart & F.col("capital") & F.coalesce(close, F.lit(False))).over(Window.partitionBy("uid", "term")), F.lit(False))
    # greatest leaves nulls out, and "remove" comes after "generalise"
    places = places.filter(apart | is_entity).withColumn("action", F.greatest("action", F.when(near, F.col("action_near"))))
    apart = ~is_entity & F.col("action").isNotNull()
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end", F.col("action").alias("value"))
    added = places.filter(apart).groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("added"))
    added = copies.join(added, "uid").select("d1", "d2", "added")

    holders = found.select("id", "uid", "d1", "d2", "spans")
    joined = spread_join(holders, added, ["d1", "d2"], copies, "copies", ["uid"])
    none = F.array().cast(f"array<{_SPAN}>")
    return joined.select("id", "spans", F.when(F.col("id").isNotNull() & F.col("added").isNotNull(), F.col("added")).otherwise(none).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text sanitised: ``<email>`` and so on for entities, ``<term>`` for generalised terms, nothing for removed ones.

    Ids have to be unique; rows without one keep their text as it is.
    """
    found = find_personal_data(docs, id_col, text_col).select(
        F.col("id").alias("_found_id"), F.array_sort(F.concat("spans", "added")).alias("_spans")
    )
    kind = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["value"] == "remove", "").otherwise(F.get(kind, s["kind"]))
        fresh = s["start"] >= acc["at"]  # a span that overlaps the one before is merged into it
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, mark))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, rest)).otherwise(text)
    joined = docs.join(found, F.col(id_col) == F.col("_found_id"), "left").withColumn("_clean", clean)
    return joined.select(*[F.col("_clean").alias(c) if c == text_col else F.col(c) for c in docs.columns])
