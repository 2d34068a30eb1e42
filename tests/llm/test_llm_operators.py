import base64
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrata.llm import abuse, chunking, components, garble, neighbours, packing, queries, tokens, transcripts

# ---------------------------------------------------------------- transcripts

CHUNK = "id long, document_id long, ordinal int, content string, audio_start_s double, audio_end_s double, speaker string, extra string"
SPEAKERS = [(1, 1, "Ada Lovell", "Operator", "Conference Operator", None), (1, 2, "Bo Winter", "CEO", "Chief Executive Officer", None), (1, 3, "Cy Winter", "Analyst", None, "Hill Research"), (2, 1, "Di Moss", "CFO", None, None)]
SPEAKER = "document_id long, speaker_no int, full_name string, role string, title string, firm string"


def turns_of(spark, rows):
    chunks = spark.createDataFrame([(i, doc, o, c, s, None if s is None else s + 1, who, "clash") for i, doc, o, c, s, who in rows], CHUNK)
    out = transcripts.turns(transcripts.speech_events(chunks, spark.createDataFrame(SPEAKERS, SPEAKER)))
    return [(r.document_id, r.speaker_no, r.first_chunk_id, r.last_chunk_id) for r in out.orderBy("document_id", "turn").collect()]


def test_turns(spark):
    rows = [
        (10, 1, 0, "Welcome.", 0.0, "Operator"), (11, 1, 1, "[laughter] um —", 5.0, "Bo Winter"), (12, 1, 2, "More of it.", None, "UNK"), (13, 1, 3, "So, we grew. Cy Winter: A question?", 20.0, "spk2"),
        (14, 1, 5, "Later by ordinal.", 15.0, "Lovell, Ada"), (15, 1, 6, "Plain talk.", 40.0, "Winter"), (9, 1, 6, "Plain talk.", 40.0, "CEO"), (16, 2, 0, "Nobody yet.", 1.0, None), (17, 2, 1, "Now me.", 2.0, "MOSS"), (18, 3, 0, "No speakers", 1.0, "CEO"),
        (19, 1, 7, None, 50.0, "CEO"), (20, 1, 8, "", 60.0, "CEO"),
    ]
    assert turns_of(spark, rows) == [(1, 1, 10, 14), (1, 2, 13, 13), (1, 3, 13, 13), (1, 2, 9, 9), (2, 1, 17, 17)]


def test_turns_cross_file_segments(spark):
    rows = [(i, 1, i, f"Line {i}.", i * 700.0, "CEO" if i % 12 == 0 else "unknown") for i in range(40)] + [(90, 1, 40, "End.", None, "Ada Lovell")]
    assert turns_of(spark, rows) == [(1, 2, 0, 39), (1, 1, 90, 90)]


def test_turns_send_no_table_through_the_driver(spark):
    """Only the ids of the documents that have speakers may be broadcast, however small the planner takes a side to be."""
    chunks = spark.createDataFrame([(1, 1, 0, "Ada: Welcome.", 0.0, 1.0, "Lovel", "")], CHUNK)
    events = transcripts.resolve_labels(chunks.select("document_id", transcripts.label_key(F.col("speaker")).alias("key")), spark.createDataFrame(SPEAKERS, SPEAKER))
    assert [tuple(r) for r in events.collect()] == [(1, "lovel", 1)]
    rows = spark.createDataFrame([(1, 1, 0, 0.0, 1.0), (1, 2, 1, 900.0, 901.0)], "document_id long, id long, ordinal int, start double, stop double")
    parsed = transcripts.speech_events(chunks, spark.createDataFrame(SPEAKERS, SPEAKER))
    for df in (events, transcripts._filled(transcripts.document_clock(rows)), transcripts.turns(parsed)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_turns_of_nothing(spark):
    chunks = spark.createDataFrame([], CHUNK)
    assert transcripts.turns(transcripts.speech_events(chunks, spark.createDataFrame(SPEAKERS, SPEAKER))).count() == 0


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("Um, we — uh — grew [00:01:02] by 4.", [(None, "We — — grew by 4.")]), ("00:03:29 --> better than planned", [(None, "Better than planned.")]), ("(applause) {pause} *coughs* ♪ ♪", [(None, "")]),
        (">> BO WINTER: Yes (see page 3).", [(None, ""), ("BO WINTER", "Yes (see page 3).")]), ("It fell. S. Moss: No.", [(None, "It fell."), ("S. Moss", "No.")]), (None, []), ("Mm-hmm.", [(None, "")]),
    ],
)
def test_parts(content, want):
    got = transcripts.parts(content)
    assert [(a, re.sub(r"(— )+", "— — ", t)) for a, t in got] == [(a, t) for a, t in want]


@pytest.mark.parametrize("label", ["Ada Lovell", "LOVELL,  ADA:", "Lovell", "A. Lovell", "Operator", "Conference Operator (Lovell)", "Speaker 1", "SPK_01", "Ada Lovel", "Ada Lovell - Operator"])
def test_spellings(spark, label):
    df = spark.createDataFrame([(1, label)], "document_id long, label string").withColumn("key", transcripts.label_key(F.col("label")))
    assert [r.speaker_no for r in transcripts.resolve_labels(df, spark.createDataFrame(SPEAKERS, SPEAKER)).collect()] == [1]


@pytest.mark.parametrize("label", ["Winter", "UNK", "—", "", None, "Speaker 9", "Someone Else"])
def test_labels_of_nobody_or_two(spark, label):
    df = spark.createDataFrame([(1, label)], "document_id long, label string").withColumn("key", transcripts.label_key(F.col("label")))
    assert transcripts.resolve_labels(df, spark.createDataFrame(SPEAKERS, SPEAKER)).count() == 0


def test_isotonic():
    assert transcripts.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])
    assert transcripts.isotonic(np.array([])).tolist() == []


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("What kind of margin do you expect?", "What kind of margin do you expect?"), ("Do you know the answer", "Do you know the answer."), ("You know what we did, I mean it.", "You know what we did, I mean it."),
        ("I mean what I said. Er, the ER (Music division) grew [Revenue, net] 5%.", "I mean what I said. The ER (Music division) grew [Revenue, net] 5%."), ("It is 5 mm wide.", "It is 5 mm wide."),
        ("We, you know, grew; it was, um, sort of slow.", "We grew; it was slow."), ("we kind of grew", "We grew."), ("You know, kind of.", ""), ("I mean, yes.", "Yes."), ("{pause} Um, [crosstalk]", ""),
        ("[" + "background noise and voices " * 9 + "] yes", "Yes."), ("(" + "a long remark that somebody made " * 5 + ")", None), ("[see note 4] it fell", "[see note 4] it fell."), ("♪ la la ♪ yes", "Yes."), ("<i>no</i> <laughs/>", "No."),
    ],
)
def test_speech_is_kept_and_noise_is_not(said, want):
    got = transcripts.tidy(said)
    assert got == want if want is not None else "somebody made" in got and len(got) > 150


def test_clock_resets_are_repaired(spark):
    """Three recordings of one call, each with a clock of its own; a row out of order alone starts no new one."""
    rows = [(f * 100 + i, 1, f * 20 + i, f"Line {f} {i}.", 100.0 * i, "CEO" if (f, i) == (0, 0) else "unknown") for f in range(3) for i in range(15)]
    rows = [(i, d, o, c, 50.0 if i == 107 else t, "Ada Lovell" if i == 205 else s) for i, d, o, c, t, s in rows]
    chunks = spark.createDataFrame([(i, doc, o, c, s, s + 120, who, "") for i, doc, o, c, s, who in rows], CHUNK)
    events = transcripts.speech_events(chunks, spark.createDataFrame(SPEAKERS, SPEAKER)).orderBy("seg", "t", "anchor", "ordinal").collect()
    assert [r.id for r in events if r.id != 107] == [i for i, *_ in rows if i != 107] and [r.id for r in events].index(107) == 16
    assert all(a.start_s <= a.end_s <= b.start_s for a, b in zip(events, events[1:], strict=False) if a.seg == b.seg)
    assert events[15].start_s > events[14].start_s and events[-1].start_s > 3000
    assert turns_of(spark, rows) == [(1, 2, 0, 204), (1, 1, 205, 214)]


def test_documents_without_times_are_split(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "ORDINALS", 4)
    rows = [(i, 1, i, f"Line {i}.", None, "CEO" if i == 0 else "unknown") for i in range(20)]
    chunks = spark.createDataFrame([(i, doc, o, c, s, None, who, "") for i, doc, o, c, s, who in rows], CHUNK)
    assert transcripts.speech_events(chunks, spark.createDataFrame(SPEAKERS, SPEAKER)).select("seg").distinct().count() == 5
    assert turns_of(spark, rows) == [(1, 2, 0, 19)]


# ----------------------------------------------------------------- neighbours


def brute_pairs(vectors, k, least):
    ids = list(vectors)
    m = np.array([vectors[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    found = set()
    for a, i in enumerate(ids):
        near = sorted((-s[a, b], j) for b, j in enumerate(ids) if j != i and s[a, b] >= least)[:k]
        found |= {(min(i, j), max(i, j)) for _, j in near}
    return found


def clustered(n, width, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 8, width))
    return (centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, width)) * 0.6).astype(np.float32)


def test_similar_pairs_recall(spark):
    data = {int(i): v for i, v in enumerate(clustered(1500, 48))}
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in data.items()] + [(9001, None, ""), (9002, [0.0] * 48, ""), (9003, [1.0], ""), (9004, [float("nan")] * 48, "")], "id long, v array<float>, shard string")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 48).collect()}
    want = brute_pairs(data, 10, 0.55)
    assert len(got & want) / len(want) > 0.97 and len(got - want) / len(got) < 0.03


def test_copies_with_a_nan_are_left_out(spark):
    v = [1.0] * 47 + [float("nan")]
    df = spark.createDataFrame([(i, v) for i in range(15)] + [(100 + i, [1.0, float(i)] + [0.0] * 46) for i in range(2)], "id long, v array<float>")
    assert [(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 48).collect()] == [(100, 101)]


def test_scaled_copies_tie_with_the_smallest_ids(spark):
    """Vectors of one direction are copies whatever their length, and every one's nearest are the smallest ids."""
    rng = np.random.default_rng(4)
    base, other = rng.normal(size=48), rng.normal(size=48)
    data = {i: (base * (1 + i / 7)).astype(np.float32) for i in range(60)} | {100 + i: (base + 0.3 * other + 0.01 * rng.normal(size=48)).astype(np.float32) for i in range(5)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "id long, v array<float>").repartition(3)
    assert {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 48).collect()} == brute_pairs(data, 10, 0.55)


def test_two_levels_of_cells_and_lots_of_visitors(spark, monkeypatch):
    for name, value in (("SHARD", 100), ("CELLS", 4), ("VISITORS", 150), ("GAP", 0.2)):
        monkeypatch.setattr(neighbours, name, value)
    data = {int(i): v for i, v in enumerate(clustered(1500, 48))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "id long, v array<float>")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 48).collect()}
    want = brute_pairs(data, 10, 0.55)
    assert len(got & want) / len(want) > 0.93 and len(got - want) / len(got) < 0.07


@pytest.mark.parametrize(("shard", "most", "gap", "least"), [(10**6, 100, 0.04, 0.99), (150, 10**6, 0.2, 0.95), (150, 100, 0.2, 0.95)])
def test_shards_and_parts(spark, monkeypatch, shard, most, gap, least):
    """Parts of a shard lose nothing; shards hardly bigger than the groups of similar vectors need a wider gap."""
    for name, value in (("SHARD", shard), ("MOST", most), ("GAP", gap)):
        monkeypatch.setattr(neighbours, name, value)
    data = {int(i): v for i, v in enumerate(clustered(900, 32, 2))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "id long, v array<float>")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 32).collect()}
    want = brute_pairs(data, 10, 0.55)
    assert len(got & want) / len(want) > least


def test_copies_and_few(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16).astype(np.float32)
    data = {i: (base if i < 40 else base * 2 if i < 43 else rng.normal(size=16).astype(np.float32)) for i in range(60)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "id long, v array<float>").repartition(5)
    assert {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 16).collect()} == brute_pairs(data, 10, 0.55)
    two = df.filter("id in (1, 41)")
    assert [(r.id_a, r.id_b) for r in neighbours.similar_pairs(two, 16).collect()] == [(1, 41)]
    assert neighbours.similar_pairs(df.limit(0), 16).count() == 0


def test_copies_make_no_more_shards(spark, monkeypatch):
    """Shards are sized by directions: six copies of every vector make the one shard that the vectors alone make, and lose nothing."""
    monkeypatch.setattr(neighbours, "SHARD", 900)
    data = {int(i) + 10_000 * c: v for c in range(6) for i, v in enumerate(clustered(900, 32, 2))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "id long, v array<float>").repartition(5)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, 32).collect()}
    want = brute_pairs(data, 10, 0.55)
    assert len(got & want) / len(want) > 0.99 and len(got - want) / len(got) < 0.01


def test_vectors_pack_without_loss():
    for v in (np.array([0.5, 1 / 1024], np.float32), np.array([0.1, 3e-9], np.float32)):
        assert np.array_equal(neighbours.unpack([neighbours.pack(v)], 2)[0], v)


# ------------------------------------------------------------------- chunking


def brute_forced(text, most=1200):
    edges = [0] + [m.end() for m in re.finditer(r"(?:(?<=[.!?])\s+|\s*\n\s*)", text)] + [len(text)]
    return int(any(len(text[a:b].strip()) > most for a, b in zip(edges, edges[1:], strict=False)))


def random_text(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(rng.randint(150, 700))]
    return "".join(w + rng.choice([" "] * rng.randint(5, 400) + [". ", "\n", "! "]) for w in words)


@pytest.mark.parametrize("seed", range(40))
def test_pieces(seed):
    text = random_text(seed)
    pieces = chunking.split(text)
    if len(text) <= 1200:
        assert pieces == [(0, len(text), False)]
        return
    assert all(0 < b - a <= 1200 for a, b, _ in pieces)
    assert not text[: pieces[0][0]].strip() and not text[pieces[-1][1] :].strip()
    assert all(b >= c or not text[b:c].strip() for (_, b, _), (c, _, _) in zip(pieces, pieces[1:], strict=False))  # nothing is lost
    assert int(any(f for _, _, f in pieces)) == int(chunking.forced_cut(text)) == brute_forced(text)


def test_an_edit_moves_near_pieces_only():
    text = " ".join(random_text(s) for s in range(50, 70))
    before = {text[a:b] for a, b, _ in chunking.split(text)}
    changed = text[:5000] + "XYZ" + text[5000:]
    after = {changed[a:b] for a, b, _ in chunking.split(changed)}
    assert len(before & after) > 0.9 * len(before)


def test_split_oversized(spark):
    long = "Word. " * 400
    df = spark.createDataFrame([(1, long, 100, "s", "clash"), (2, "short", 0, "s", ""), (3, None, None, None, ""), (4, "x" * 1300, None, None, ""), (5, "é" * 1200, 0, "s", "")], "id long, content string, char_start int, section string, piece string")
    got = chunking.split_oversized(df).collect()
    assert {r.chunk_id for r in got} == {1, 4}
    assert all(r.content == long[r.char_start - 100 : r.char_end - 100] and r.section == "s" and r.forced == 0 for r in got if r.chunk_id == 1)
    assert all(r.char_start is None and r.forced == 1 for r in got if r.chunk_id == 4)
    assert chunking.split_oversized(df.limit(0)).count() == 0


# ----------------------------------------------------------------- components


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(300)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    got = {r.vertex: r.root for r in components.contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in list(parent)[::7] for b in list(parent)[::11])


def test_match_groups(spark):
    reports = spark.createDataFrame([(1, "A"), (2, " b "), (3, "c"), (4, "d"), (5, None)], "id long, point_id string")
    matches = spark.createDataFrame([("B", "a", 1), ("b", "A ", 2), ("c", "zzz", 3), (None, "c", 4), ("d", "D", 5)], "point_a string, point_b string, id int")
    assert sorted((r.report_id, r.group_id) for r in components.match_groups(matches, reports).collect()) == [(1, 1), (2, 1)]
    assert components.match_groups(matches.limit(0), reports).count() == 0


# --------------------------------------------------------------------- garble


def test_pairs_beyond_those_in_memory_count(spark, monkeypatch):
    """The model and what it finds are the same however few pairs are held in memory."""
    rng = random.Random(3)
    words = ["café", "naïve", "résumé", "ß-Strahl", "œuvre", "plain", "margin", "Größe", "señor", "año"]
    rows = [("t", i, " ".join(rng.choices(words, k=12))) for i in range(300)]
    rows += [("t", 1000 + i, " ".join(rng.choices(words, k=6)).encode().decode("latin-1")) for i in range(5)]
    df = spark.createDataFrame(rows, "table_name string, record_id long, text string")
    codes = garble._codes([t for _, _, t in rows] + ["quite new \u4e2d"])
    whole, found = garble.pair_model(df), sorted(map(tuple, garble.find_garbled(df).collect()))
    assert not whole.files and len(found) >= 5
    monkeypatch.setattr(garble, "MOST_PAIRS", 20)
    few = garble.pair_model(df)
    assert len(few.codes) == 20 and few.level == whole.level
    for by_rows in (False, True):
        assert np.array_equal(few._shares(codes, by_rows), whole._shares(codes, by_rows))
    assert sorted(map(tuple, garble.find_garbled(df).collect())) == found


def test_garbled_records(spark):
    rng = random.Random(5)
    vocabulary = ["Café", "Łodzin", "naïve", "plant", "margin", "– rose", "“ordinary wear”", "São Brisco", "Größe", "of", "the", "units", "Ålvik", "€5"]
    texts = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(600)]
    rows = [("chunks", i, t) for i, t in enumerate(texts)] + [("chunks", 700, None), ("chunks", 701, ""), ("chunks", 702, "plain")]
    bad = {}
    for i in range(800, 840):
        t = rng.choice(texts) + " Café"
        bad[i] = t
        rows.append(("chunks", i, t.encode("utf-8").decode("cp1252", "replace") if i % 2 and "�" not in t.encode("utf-8").decode("cp1252", "replace") else t.encode("utf-8").decode("latin-1")))
    df = spark.createDataFrame(rows, "table_name string, record_id long, text string")
    got = {r.record_id: r for r in garble.find_garbled(df).collect()}
    assert set(got) == set(bad)
    assert sum(got[i].restored == bad[i] for i in bad) >= 0.9 * len(bad)
    assert garble.find_garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [20, 3, 1])
def test_frequent_garbling_is_found(spark, share):
    """Also where garbled records are copies or make up a third or all of the corpus, and the right character occurs nowhere."""
    sound = "Большой «БВП» Größe naïve 北京 “quoted” São ┌┐ — x"
    rows = [("chunks", i, f"row {i} {sound}") for i in range(1200 if share > 1 else 0)]
    wrong = [f"row {i} margin â€“ 5 and CafÃ© of Â£{i}" for i in range(1200 // share)]
    rows += [("chunks", 10_000 + i, t) for i, t in enumerate(wrong)] + [("table_cells", 20_000 + i, "â€”") for i in range(1200 // share)]
    rows += [("table_cells", 30_000 + i, "a chunk of ‚Äúlonger‚Äù text that was reposted") for i in range(1200 // share)]
    got = {r.record_id: r for r in garble.find_garbled(spark.createDataFrame(rows, "table_name string, record_id long, text string")).collect()}
    assert set(got) == {i for _, i, _ in rows if i >= 10_000}
    assert got[10_000].restored == "row 0 margin – 5 and Café of £0" and got[20_000].restored == "—"
    assert got[30_000].restored == "a chunk of “longer” text that was reposted"


def test_copies_of_a_one_byte_mix_up_are_found(spark):
    """A nil mark read with another one-byte encoding, a third as often as the sound one."""
    rows = [("chunks", i, f"row {i} of the plain text") for i in range(1000)]
    rows += [("table_cells", 10_000 + i, "—" if i % 4 else "Ñ") for i in range(800)]
    got = {r.record_id: r.restored for r in garble.find_garbled(spark.createDataFrame(rows, "table_name string, record_id long, text string")).collect()}
    assert got == {10_000 + i: "—" for i in range(0, 800, 4)}


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        s = rng.normal(size=14)
        found = garble.maximal_segments(s)
        best = max(((s[a:b].sum(), a, b) for a in range(14) for b in range(a + 1, 15)), key=lambda x: x[0])
        if best[0] > 0:
            assert any(s[a:b].sum() == pytest.approx(best[0]) for a, b in found)
        assert all(b <= c for (_, b), (c, _) in zip(found, found[1:], strict=False))


# --------------------------------------------------------------------- tokens


def test_tokens_against_the_public_encoder(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["", None, "a", "Hello  world's\n\n tabs\t\t", "日本語のテキスト 🚧🚲", "x" * 3000, "<|endoftext|>", "​ é" * 50, " ".join("".join(rng.choices("abcdeéß漢", k=rng.randint(1, 20))) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_documents(df).collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.tokens for r in tokens.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}


# -------------------------------------------------------------------- packing


def best_fit(sizes, capacity=2048):
    """Containers that best fit decreasing takes, item by item."""
    free, made = [], sum(n // capacity for n in sizes)
    for n in sorted((n % capacity for n in sizes if n % capacity), reverse=True):
        fits = [x for x in free if x >= n]
        if fits:
            free.remove(min(fits))
        else:
            made += 1
            fits = [capacity]
        free.append(min(fits) - n)
    return made


def test_packing(spark):
    rng = random.Random(1)
    sizes = [rng.choice([700, 700, 700, rng.randint(1, 2048), rng.randint(1, 300)]) for _ in range(900)] + [5000, 2048, 4096, 0, None]
    df = spark.createDataFrame([(i // 2 if i < 10 else i, n, "clash") for i, n in enumerate(sizes)], "doc_id long, tokens int, container string")
    pieces = packing.pack(df).toPandas()
    total = sum(n for n in sizes if n)
    assert pieces.tokens.sum() == total and pieces.groupby("container").tokens.sum().max() <= 2048
    whole = pieces.groupby(["doc_id"]).size()
    assert all(n == 1 for d, n in whole.items() if d >= 10 and sizes[d] and sizes[d] <= 2048)
    assert pieces.container.nunique() <= best_fit([n for n in sizes if n]) + 1
    report = packing.fill_report(packing.pack(df)).first()
    assert (report.containers, report.tokens) == (pieces.container.nunique(), total)
    assert packing.pack(df.limit(0)).count() == 0


# ---------------------------------------------------------------------- abuse

CURSES = ["you are a filthy crook", "shut up you lying bastard", "drop dead all of you"]
PLAIN = ["the lamp is dark by the bakery", "sales rose by four percent", "please fix the kerb stone", "staff took harassment training", "depreciation follows the straight line"]


def labelled(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        parts = rng.choices(PLAIN, k=3) + ([rng.choice(CURSES)] if bad else [])
        rng.shuffle(parts)
        rows.append((i, ". ".join(parts) + ".", "abusive" if bad else "none"))
    return rows


def test_abuse_on_held_out_documents(spark):
    rows = labelled()
    flipped = {i for i, _, _ in rows if i % 41 == 0}  # raters err
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t, _ in rows] + [(9000, None, "b", 1), (9001, "", None, 1), (9002, "You are a f1lthy cr00k.", "b", 1), (9003, "SHUT UP you lying baaaastard", "b", 1)], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, "r", (("none" if y != "none" else "abusive") if i in flipped else y).upper()) for i, _, y in rows if i % 2 == 0] + [(9999, "r", "none"), (None, "r", "none")], "doc_id long, rater string, label string")
    scores = abuse.score_documents(docs, labels).toPandas().set_index("doc_id")
    held = [(i, y != "none") for i, _, y in rows if i % 2]
    assert np.mean([scores.found[i] == y for i, y in held]) > 0.95
    assert scores.found[9002] and scores.found[9003] and not scores.found[9000] and not scores.found[9001]
    rates = {r.source: r.documents for r in abuse.rates(abuse.score_documents(docs, labels)).collect()}
    assert rates == {"a": 400, "b": 3, None: 1}


def test_abuse_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, rater string, label string")
    assert not abuse.score_documents(docs, labels).first().found
    assert abuse.score_documents(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize(("disguised", "want"), [("b a s t a r d", ["bastard"]), ("Baaaastard", ["bastard"]), ("b@st@rd", ["bastard"]), ("b​astard", ["bastard"]), ("bаstаrd", ["bastard"]), ("f1lthy", ["filthy"]), ("h*****f", ["h*f"]), ("2031", ["9"])])
def test_disguises(disguised, want):
    assert abuse.words(abuse.plain(disguised)) == want


@pytest.mark.parametrize("word", ["x" * 55 + "bastard", "1x2y3z4w5v6u7" + "bastard" * 3, "b.a.s.t.a.r.d " * 20])
def test_every_letter_of_a_long_word_is_read(word):
    pieces = abuse.words(abuse.plain(word))
    assert any("bastard" in w for w in pieces) and all(len(w) <= abuse.PIECE for w in pieces)
    assert abuse.words("0123456789abcdef0123") == ["9"]


def test_training_is_repeatable_and_reads_every_window(spark):
    """Of a long labelled document the telling sentence counts wherever it stands; partitions and order of rows change nothing."""
    dull = [f"The plant in area {i} ran well on day {i * 7} and sold {i * 3} units of item {i % 17}." for i in range(400)]
    docs = [(i, " ".join(dull[i : i + 300] + (["You are a rotten filthy crook."] if i % 2 else []) + dull[: 40 - i])) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", "abusive" if i % 2 else "none") for i, _ in docs], "doc_id long, rater string, label string")
    a, b = abuse.fit_labels(frame, labels), abuse.fit_labels(frame.repartition(3), labels.repartition(2))
    assert np.allclose(a.table, b.table, atol=1e-5)
    assert a.probabilities(abuse.windows("You are a rotten filthy crook."))[:, 0].min() < 0.5 < a.probabilities(abuse.windows(dull[3]))[:, 0].min()


# -------------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    if name.endswith("_found"):
        want = {"p2": ["document_id", "speaker_no", "first_chunk_id", "last_chunk_id"], "p3": ["table_name", "id_a", "id_b"], "p4": ["chunk_id", "forced"], "p5": ["report_id", "group_id"], "p6": ["table_name", "record_id"], "p10": ["doc_id"]}
        assert df.columns == want[name.split("_")[0]]
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows) and (not name.endswith("_found") or len(set(rows)) == len(rows))
