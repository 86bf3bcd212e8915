"""BPE, classifiers, decontamination, personal data, set joins and the pipeline on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorage.llm import jaccard, pii
from anchorage.llm.bpe import Encoder, round_trip, tokenize
from anchorage.llm.components import components
from anchorage.llm.decontamination import contaminated, decontaminate
from anchorage.llm.jaccard import keep_one_of_each, list_pairs, similar_sets
from anchorage.llm.linear import training_rows
from anchorage.llm.quality import fit_quality, score_quality
from anchorage.llm.queries import CATEGORIES, GRADE, RANKS_PATH
from anchorage.llm.toxicity import fit_toxicity, score_toxicity, without_toxic
from llm_samples import prose


@pytest.fixture(scope="module")
def coder():
    return Encoder(RANKS_PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


# --- byte-level BPE ---------------------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sthéß1٣中🙂.!$"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_library(coder, library, text):
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("word", ["a" * 50_000, "abcab" * 8_000, " " * 20_000, "é" * 10_000 + "x"], ids=lambda w: w[:5])
def test_very_long_pre_tokens(coder, library, word):
    assert np.frombuffer(coder.encode(word), "<u4").tolist() == library.encode_ordinary(word)


def test_tokenize_keeps_rows_and_columns(frame, library):
    rows = [(1, "Hello  world \n"), (2, None), (3, ""), (1, "Hello  world \n"), (None, "x" * 9000)]
    got = tokenize(frame(rows), RANKS_PATH, public_tokenizers.PATTERN, out_col="window").collect()
    assert [(r.doc_id, r.window) for r in got] == [(i, library.encode_ordinary(t or "")) for i, t in rows]
    trip = round_trip(frame(rows), RANKS_PATH, public_tokenizers.PATTERN).collect()
    assert [r.n_tokens for r in trip] == [len(r.window) for r in got]
    assert round_trip(frame([]), RANKS_PATH, public_tokenizers.PATTERN).collect() == []


# --- classifiers ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def rated(frame, spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = prose(i, rnd.randint(8, 80)).split(" ")
        toxic, poor = int(i % 5 == 0), int(i % 3 == 0)
        for _ in range(2 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vilest", "vilely", "viler"]))
        if poor:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 2 else 1 - poor, None if i == 17 else toxic))
    return frame([*rows, (900, None), (901, ""), (902, " \n ")]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_rows_without_labels(rated):
    docs, labels = rated
    chain = fit_toxicity(docs, labels, CATEGORIES)
    assert [len(m.extra) for m in chain] == [0, 1]
    got = {r.id: r for r in score_toxicity(docs, chain, list(CATEGORIES)).collect()}
    held_out = [i for i in range(400) if i % 2]
    assert np.mean([(got[i].p_toxic >= 0.5) == (i % 5 == 0) for i in held_out]) > 0.95
    assert all(0 <= got[i].p_toxic < 0.5 for i in (900, 901, 902))
    kept = without_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.p_toxic < 0.5}


def test_quality_on_rows_without_ratings(rated):
    docs, labels = rated
    got = {r.id: r for r in score_quality(docs, fit_quality(docs, labels, GRADE, 2)).collect()}
    held_out = [i for i in range(400) if i % 2]
    assert np.mean([(got[i].p_tail[0] >= 0.5) == (i % 3 > 0) for i in held_out]) > 0.95
    assert all(r.p_tail[0] >= r.p_tail[1] and abs(sum(r.p_tail) - r.expected_grade) < 1e-9 for r in got.values())


def test_repeated_labels(rated):
    """Of several labels of one document the greatest counts, in whatever order they come."""
    docs, labels = rated
    twice = labels.unionByName(labels.selectExpr("doc_id", "0 AS quality", "0 AS toxic"))
    rows = training_rows(docs, twice, "doc_id", "text", ["quality", "toxic"], 10_000)
    got = {r.id: (r.quality, r.toxic) for r in rows.collect()}
    assert got == {r.doc_id: max((r.quality, r.toxic), (0, 0)) if None not in (r.quality, r.toxic) else (0, 0) for r in labels.collect()}


def test_models_without_labels_and_documents(rated, frame, spark):
    docs, labels = rated
    none = labels.limit(0)
    assert {r.p_toxic < 1e-9 for r in score_toxicity(docs, fit_toxicity(docs, none, CATEGORIES), list(CATEGORIES)).collect()} == {True}
    assert {r.expected_grade < 1e-9 for r in score_quality(docs, fit_quality(docs, none, GRADE, 2)).collect()} == {True}
    assert score_toxicity(frame([]), fit_toxicity(frame([]), labels, CATEGORIES), list(CATEGORIES)).collect() == []


# --- decontamination --------------------------------------------------------------------------------
ITEM = "A train with 12 wagons leaves for Oslo at 9.30 and Anna counts 12 birds, then rides 40 km before noon today."


def test_templates(frame, spark):
    items = spark.createDataFrame(
        [(1, ITEM), (2, "too short"), (3, None), (4, ""), (5, prose(50, 30))], "item_id bigint, text string"
    )
    rows = [
        (1, prose(1, 200) + " " + ITEM + " " + prose(2, 10)),
        (2, ITEM.replace("12", "7").replace("Anna", "Berit").replace("Oslo", "Turku").replace("40 km", "31 miles")),
        (3, ITEM.replace("12 wagons", "7 wagons")),  # 12 is now both 7 and 12
        (4, ITEM.replace("wagons", "cars").replace("counts", "sees").replace("rides", "walks")),
        (5, None), (6, ""), (7, "1 2 3 4 5 6 7 8 9 10 " * 30), (8, prose(3, 5000)), (9, prose(50, 30).upper()),
        (1, ITEM), (None, ITEM),
    ]
    docs = frame(rows)
    for bound in (10**6, 0):  # broadcast, and shuffled
        got = contaminated(docs, items, broadcast_rows=bound).collect()
        assert sorted((r.id, r.item_id) for r in got) == [(1, 1), (2, 1), (9, 5)]
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 5, 6, 7, 8]
    assert contaminated(frame([]), items).collect() == [] and contaminated(docs, items.limit(0)).collect() == []


def test_leaks_with_shifts_names_and_long_runs(frame, spark):
    words = prose(70, 38).split()
    story = (
        "Anna buys 12 red apples at the old market near the river. Anna gives 5 of them to her friend Bo before lunch. "
        "Anna then eats 2 apples and puts the rest of the apples into a basket. How many apples does Anna have left now?"
    )
    long = prose(80, 60).split()
    table = [(1, " ".join(words)), (2, story), (3, " ".join(long))]
    items = spark.createDataFrame(table, "item_id bigint, text string")
    around = prose(90, 30), prose(91, 30)
    rows = [
        (1, f"{around[0]} {' '.join(words[:19])} inserted {' '.join(words[19:])} {around[1]}"),
        (2, f"{around[0]} {' '.join(words[:19] + words[20:])} {around[1]}"),
        (3, f"{around[0]} {story.replace('Anna', 'Mary Jane').replace('12', '30')} {around[1]}"),
        (4, f"Question {story.replace('Anna', 'Olga')} {around[1]}"),
        (5, f"{around[0]} {' '.join(long[20:40])} {around[1]}"),
        (6, f"{around[0]} {' '.join(long[20:35])} {around[1]}"),  # neither half of the item nor a long run
        (7, f"{around[0]} {story.replace('Anna gives', 'Olga gives')} {around[1]}"),  # Anna is two people
    ]
    for bound in (10**6, 0):
        got = contaminated(frame(rows), items, broadcast_rows=bound).collect()
        assert sorted((r.id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]
    assert {(r.id, r.n_matched, r.n_windows) for r in got if r.item_id == 1} == {(1, 24, 31), (2, 23, 31)}
    assert {(r.n_matched, r.n_windows) for r in got if r.id == 5} == {(13, 53)}


# --- personal data ----------------------------------------------------------------------------------
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def base_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            fine = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else None, 14 <= len(digits) <= 19 and luhn, 10 <= len(digits) <= 15]
            if fine[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rnd = random.Random(8)
    parts = ["a", "b.c", "@", "@x.y", "_d", "1", "192.168.1.1", "256", ".", "-", " ", "+", "+1", "4111 1111 1111 1111", "\n", "🙂", "+46 70 123 45 67"]
    parts += ["a@b.c_d@e.f", "00012.1.1.1", "1" * 20, "4111111111111111"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(800)] + ["1 " * 9000, "a@b.c;" * 3000, "1." * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = df.select("id", pii.base_spans(F.col("text")).alias("s")).collect()
    assert all([(s.start, s.kind, s.end) for s in r.s] == base_spans(texts[r.id]) for r in got)


def test_revealing_terms(frame):
    mail = "quinn@corp.example"
    rows = [(i, f"{prose(i, 12)}\nProject Nightjar is led by {mail} since week {i}.\n{prose(i + 50, 12)}") for i in range(8)]
    rows += [(i, f"{prose(i, 30)} since week project led") for i in range(100, 140)] + [(90, None), (91, ""), (None, f"Nightjar {mail}")]
    docs = frame(rows)
    found = {r.id: r for r in pii.find_personal_data(docs).collect()}
    for i, text in rows[:8]:
        assert [text[s.start : s.end] for s in found[i].spans] == [mail]
        assert "Nightjar" in {text[s.start : s.end] for s in found[i].added}
        assert not {"since", "week"} & {text[s.start : s.end] for s in found[i].added}
    assert all(not r.added and not r.spans for i, r in found.items() if i is not None and i >= 90)
    assert len(found[None].spans) == 1 and not found[None].added
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Nightjar" not in clean[3] and "<email> since week 3." in clean[3] and clean[90] is None and clean[91] == ""
    assert clean[120] == dict(rows)[120]
    assert pii.find_personal_data(frame([])).collect() == []


def test_terms_of_rare_entities(frame):
    """Entities of one and two documents, terms on other lines, and copies that prove no more than one text."""
    card = "Name: Xanthippe\n\nPhone: +46 70 123 45 67\n" + "common filler\n" * 40 + "Yours, xanthippe"
    rows = [(1, card), (2, "Call Ondine.\nOffice\n\nMail: o@corp.example"), (3, "From Ondine again\n\no@corp.example, Phone Mail"), (4, card), (None, card)]
    rows += [(i, f"common filler Name Phone Mail Yours Call Office From again {prose(i, 9)}") for i in range(10, 60)]
    for bound in (10**6, 0):  # copies broadcast, and shuffled
        got = pii.find_personal_data(frame(rows), broadcast_rows=bound).collect()
        found = {r.id: ([s.start for s in r.spans], [(s.start, s.end, s.value) for s in r.added]) for r in got}
        check_rare(found, card, rows)


def check_rare(found, card, rows):
    def terms(i, text):
        return [(text[a:b], action) for a, b, action in found[i][1]]

    assert terms(1, card) == terms(4, card) == [("Xanthippe", "remove"), ("xanthippe", "remove")]
    assert terms(2, rows[1][1]) == [("Ondine", "remove")] and terms(3, rows[2][1]) == [("Ondine", "remove")]
    assert len(found[None][0]) == 1 and not found[None][1] and not any(found[i][1] for i in range(10, 60))


def brute_added(rows):
    """The added spans from their definition, over all pairs of entities and terms."""
    texts = {t for i, t in rows if i is not None}
    low = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
    terms = {t: low(t) for t in texts}
    places = {t: base_spans(t) for t in texts}
    entities = {t: {(k, t[a:b].lower()) for a, k, b in places[t]} for t in texts}
    held, total = {}, len(texts)
    for t in texts:
        for e in entities[t]:
            held.setdefault(e, set()).add(t)
    n_t = Counter(w for t in texts for w in terms[t])
    verdict = {}
    for e, some in held.items():
        for w in set().union(*(terms[t] for t in some)):
            both, n, z = sum(w in terms[t] for t in some), n_t[w], pii.ERRORS
            p = both / n
            if both > pii.FEW:
                p = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            ic = math.log2(total / len(some))
            told = round(math.log2(p * total / len(some)) / ic, 9) if ic else 0
            if told >= pii.GENERALISE:
                verdict[e, w] = (both <= pii.FEW, "remove" if told >= pii.REMOVE else "generalise")
    added = {}
    for t in texts:
        words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        words = [x for x in words if all(x[2] <= a or b <= x[1] for a, _, b in places[t])]
        close = lambda a, b: any(0 <= a - y <= pii.NEAR or 0 <= x - b <= pii.NEAR for x, _, y in places[t])
        near = {w for w, a, b in words if t[a].isupper() and close(a, b)}
        found = []
        for w, a, b in words:
            acts = [act for e in entities[t] for few, act in [verdict.get((e, w), (True, None))] if act and (not few or w in near)]
            if acts:
                found.append((a, b, max(acts)))
        added[t] = found
    return added


def test_added_spans_by_brute_force(frame):
    rnd = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(160):
        words = prose(i, rnd.randint(5, 60)).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            which = int(40 * rnd.random() ** 0.5)  # some entities in one text, some in many
            name = f"Xan{letters[which % 26]}{letters[which // 26]}"
            at = rnd.randrange(len(words))
            words[at:at] = [f"u{which}@corp.example", rnd.choice([name, name, name.lower()]), rnd.choice(["since", f"Odd{letters[i % 26]}"])]
            words.insert(rnd.randrange(len(words)), rnd.choice([name.upper(), f"apart{letters[i % 26]}"]))
        rows.append((i, " ".join(words)))
    rows += [(200, rows[3][1]), (201, rows[8][1]), (202, ""), (203, None), (None, rows[8][1])]
    want = brute_added([(i, t or "") for i, t in rows])
    assert sum(map(len, want.values())) > 30 and {a for found in want.values() for *_, a in found} == {"remove", "generalise"}
    for r in pii.find_personal_data(frame(rows)).collect():
        assert [(s.start, s.end, s.value) for s in r.added] == ([] if r.id is None else want[dict(rows)[r.id] or ""]), r.id


# --- set joins --------------------------------------------------------------------------------------
def similar(texts, n, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_similar_sets(frame, n, num):
    rnd = random.Random(n)
    base = prose(5, 150).split()
    rows = [(100, None), (101, ""), (102, " \n"), (103, "One two"), (104, "one TWO "), (105, prose(6, 8000)), (106, "É x y z"), (107, "é x y z")]
    for i in range(90):  # near copies of one text, from equal to too far
        words = list(base)
        for _ in range(i % 6):
            words[rnd.randrange(len(words))] = f"new{rnd.random()}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(300 + i, 60) + " " + " ".join(base[:30])) for i in range(60)]  # one shared passage
    expected = similar(rows, n, num, 100)
    docs = frame([*rows, (None, " ".join(base))])
    got = {(r.id, r.n_shingles, r.component) for r in similar_sets(docs, n, (num, 100)).collect()}
    assert {g for g in got if g[0] is not None} == expected
    if n == 5:
        kept = keep_one_of_each(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {c for _, _, c in expected} | {None}
        assert similar_sets(frame([])).collect() == []


def test_pairs_of_a_family_do_not_grow_with_its_square(frame, monkeypatch):
    """Near copies, many too far from each other to link: 40 pairs each at most, and the same components."""
    rnd = random.Random(9)
    base, made = prose(7, 150).split(), []
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(i % 9):
            words[rnd.randrange(len(words))] = f"new{rnd.random()}"
        rows.append((i, " ".join(words)))
    stage = jaccard.stage

    def counted(df, name, **options):
        staged = stage(df, name, **options)
        made.extend([staged.count()] if name in ("pairs", "links") else [])
        return staged

    monkeypatch.setattr(jaccard, "stage", counted)
    got = {(r.id, r.n_shingles, r.component) for r in similar_sets(frame(rows), 5, (80, 100)).collect()}
    assert got == similar(rows, 5, 80, 100)
    assert sum(made) < 40 * len(rows)


def test_family_pairs_lose_no_pair():
    """Sets around a pivot: pairs that are similar enough link with it both, or share a difference in their prefixes."""
    rnd = random.Random(4)
    met = 0
    for turn in range(60):
        num = rnd.choice([60, 80, 90])
        pivot = [f"w{k}" for k in range(rnd.randint(8, 40))]
        texts = []
        for _ in range(25):
            words = list(pivot)
            for _ in range(rnd.randrange(10)):
                at = rnd.randrange(len(words))
                words[at : at + rnd.randint(0, 1)] = [f"n{rnd.randrange(6)}"] * rnd.randint(0, 2)
                words = words or ["w0"]
            texts.append(" ".join(words))
        batch = pa.RecordBatch.from_arrays(
            [pa.array([99] * len(texts)), pa.array(range(len(texts))), pa.array([" ".join(pivot)] * len(texts)), pa.array(texts)],
            names=["a", "b", "text_a", "text_b"],
        )
        kin = pa.Table.from_batches(jaccard._differences(1, (num, 100))(iter([batch])))
        common = [[int(x) for x in rnd.sample(np.frombuffer(t, "<i8").tolist(), len(t) // 24)] for t in kin["tokens"].to_pylist()]
        common = sorted({x for row in common for x in row}) if turn % 2 else None
        kin = kin.append_column("common", pa.array([common] * len(kin), pa.list_(pa.int64())))
        rows = pa.Table.from_batches(jaccard._unroll_differences(iter(kin.to_batches())))
        names = ("family", "token", "id", "n", "apart", "pos", "linked", "short", "id")
        got = {tuple(sorted(p)) for p in jaccard.family_pairs(*(rows[c].to_numpy() for c in names), (num, 100)).tolist()}
        sets = {i: set(texts[i].split()) for i in kin["id"].to_pylist()}
        linked = dict(zip(kin["id"].to_pylist(), kin["linked"].to_pylist()))
        for i in sets:
            assert linked[i] == (100 * len(sets[i] & set(pivot)) >= num * len(sets[i] | set(pivot)))
            for j in sets:
                similar_ = 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])
                if i < j and similar_ and sets[i] != sets[j] and not (linked[i] and linked[j]):
                    assert (i, j) in got
                    met += 1
    assert met > 100


def test_lists_skip_no_pair():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        m = int(rnd.integers(0, 200))
        token, ids = rnd.integers(0, 3, m), np.arange(m)
        n, pos, comp = rnd.integers(1, 40, m), rnd.integers(0, 8, m), rnd.integers(0, 5, m)
        got = {tuple(sorted(p)) for p in list_pairs(token, ids, n, pos, comp, (80, 100), None).tolist()}
        expected = {
            (a, b)
            for a in range(m)
            for b in range(a + 1, m)
            if token[a] == token[b] and comp[a] != comp[b] and 80 * max(n[a], n[b]) <= 100 * min(n[a], n[b])
            and 180 * min(n[a] - pos[a], n[b] - pos[b]) >= 80 * (n[a] + n[b])
        }
        assert got == expected


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    expected = {}
    for start in sorted(near):
        todo = [start] if start not in expected else []
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = start
                todo.extend(near[x])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: c for i, c in expected.items() if near[i] != {i}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- pipeline ---------------------------------------------------------------------------------------
def test_pipeline(spark, tmp_path, library):
    import corpus_pipeline

    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(200):
        words = prose(i, 70).split()
        if i % 5 == 0:
            words[rnd.randrange(60)] = words[rnd.randrange(60)] = "vilest"
            words[5] = "vilely"
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, i % 2, int(i % 5 == 0)))
    clean = dict((r[0], r[1]) for r in rows if r[0] % 5)
    rows += [(1000 + i, clean[i], None, None, None) for i in (1, 2, 3)]
    rows += [(2000 + i, clean[i] + " tail", "en", "s", 1) for i in (4, 6, 7)]
    rows += [(3000, prose(900, 40) + " " + ITEM, "en", "s", 1), (3001, None, "en", "s", 1), (3002, "", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = (set(clean) - {1, 2, 3}) | {1001, 1002, 1003, 3002}
    assert set(got) == kept
    assert all(r.token_ids == library.encode_ordinary(r.text or "") for r in got.values())
