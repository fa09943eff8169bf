"""The corpus operators against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcast.llm import chat, common, components, decontamination, embeddings, jaccard, lines, packed, packing, passages, secrets, substrings, toxicity
from loomcast.llm.common import hold, lean, words_of
from loomcast.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, start long, items string"  # with names that operators use inside


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "clash") for i, t in rows], DOCS)


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.choice([3, 8, 60, 200]))) for i in range(60)]
    base, passage = sentence(rng, 150), sentence(rng, 60)
    for i in range(60, 75):
        words = base.split()
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words)))
    rows += [(i, f"{sentence(rng, 70)} {passage} {sentence(rng, 70)}") for i in range(75, 80)]
    rows += [(80, None), (81, ""), (82, "é" * 200), (83, rows[0][1]), (83, rows[0][1]), (84, "\n\n"), (85, "a " * 500), (None, base)]
    return rows


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, r)
    return out


def groups_of(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30) if i % 10] + [(100, j) for j in range(101, 140)] + [(3, 3), (5, 6)]
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == groups_of(edges, nodes)
    assert connected_components(df.where("a < 0")).count() == 0


def test_components_take_few_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(components, "stored", lambda df, tag, put=components.stored: steps.append(tag) or put(df, tag))
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(900)]
    rng.shuffle(edges)
    df, want = spark.createDataFrame(edges, "a long, b long"), groups_of(edges, {x for a, b in edges if a != b for x in (a, b)})
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert len(steps) == 1  # these edges lie in one task
    steps.clear()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = connected_components(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    assert len(steps) > 1


def test_parts_of_a_task_are_told_apart(monkeypatch):
    monkeypatch.setattr(components, "HELD", 4)
    monkeypatch.setattr(components, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 7})())}))
    whole = pa.record_batch([pa.array([2, 4, 6, 8, 9]), pa.array([1, 3, 5, 7, 8])], names=["a", "b"])
    more = pa.record_batch([pa.array([3, 11]), pa.array([2, 10])], names=["a", "b"])
    out = [row for batch in components._tied(iter([whole, more])) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert {t for *_, t in out} == {7, 7 + (1 << 32)}
    ends = {x for a, b, _ in out for x in (a, b)}
    assert groups_of([x[:2] for x in out], ends) == groups_of([(2, 1), (4, 3), (6, 5), (8, 7), (9, 8), (3, 2), (11, 10)], ends)


def test_packed_round_trip():
    arrays = [np.array([5, -9, 2**62]), np.array([1, 2], np.uint64), np.zeros((3, 4), np.uint8), np.array([], np.int64), np.array([-3, 200])]
    back = packed.load(packed.dump(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))


def test_secrets(spark):
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(64))
    texts = {
        1: 'x API_KEY = "abcdef12" token: secret=abcdef é', 2: "AKIA" + "B" * 16 + " AKIA123 " + "0a" * 12, 3: None, 4: "",
        5: f"see {key} here", 6: "password=abc", 7: "plain words only " * 200,
    }
    got = by_id(secrets.secret_spans(docs(spark, list(texts.items()))))
    for i, text in texts.items():
        want = []
        for m in re.finditer("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.I | re.A):
            if len(m[2]) >= 6:
                want.append(("assign", *m.span()))
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        assert sorted(want) == sorted((s.kind, s.start, s.end) for s in got[i].spans if s.kind != "random")
    assert [(s.kind, s.start, s.end) for s in got[5].spans] == [("random", 4, 68)]
    assert not got[7].spans


def test_battery_tells_random_from_ordered():
    rng = random.Random(2)
    noise = "".join(rng.choice("0123456789abcdef") for _ in range(200))
    enc = secrets.encoding_of(noise)
    assert secrets.ALPHABETS[enc][0] == "hex"
    assert secrets.battery(noise, enc)[1] > 1e-3
    assert secrets.battery("0123456789abcdef" * 12, enc)[1] < 1e-3
    assert secrets.battery("aaaaaaaaaabbbbbbbbbb0000000000", enc)[1] < 1e-3
    assert secrets.step_up({100: 3, 900: 2}, 0.01) == 900 or secrets.step_up({100: 3, 900: 2}, 0.01) <= 900


def test_substrings_equal_brute_force(spark, corpus):
    got = substrings.repeated_bytes(docs(spark, corpus)).collect()
    known = sorted({(i, t or "") for i, t in corpus if i is not None})
    seen, want = {}, {}
    for i, t in known:
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen.get(b[k : k + 50], i) < i:
                cover[k : k + 50] = True
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()
        want[i] = (len(b), int(cover.sum()), runs, kept)
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        else:
            assert r.n_removed == 0


def test_secret_candidates_are_whole():
    import pyarrow as pa

    token, word = "Ab3-x_9Kq7ZtR-w2LmN_5vYc8dHj0PsQ", "q8Zr+T4m/W9xKc2Vb7Yn"
    text = f"see host/reset/{token} or {word}-hyphenated_word and 83920174650291837465 or QWZRTPLKMNBVCXYG"
    rows = next(secrets.scan([pa.record_batch([pa.array([1]), pa.array([text])], names=["doc_id", "text"])])).to_pylist()
    found = {text[x["start"] : x["end"]]: secrets.ALPHABETS[x["enc"]][0] for x in rows[0]["found"]}
    assert found[token] == "base64url" and found[word] == "base64"
    assert found["83920174650291837465"] == "decimal" and found["QWZRTPLKMNBVCXYG"] == "base32"


def test_copies_are_equal_in_whole(spark):
    head, foot = "the common header of this source " * 3, " and the common footer of this source" * 3
    rows = [(f"{head}{body}{foot}", 1) for body in ("one thing", "another thing", "Another  THING")]
    got = toxicity.weighted(spark.createDataFrame(rows, "text string, toxic int")).collect()
    assert sorted(r.weight for r in got) == [0.5, 0.5, 1.0]


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        words = sentence(rng, 40, 5000).split()
        if i % 3 == 0:
            words[rng.randrange(40)] = rng.choice(["grubby", "snarkle"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    table = docs(spark, [*rows, (900, None), (901, ""), (902, "ask grubbу"), (903, "ask sn4rkle")])
    weights, score = toxicity.learn(toxicity.training_rows(table, spark.createDataFrame(labels, "doc_id long, toxic int")))
    got = by_id(toxicity.toxicity(table, weights, score))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(got[i].predicted == label for i, label in labels)
    assert [got[i].predicted for i in (900, 901, 902, 903)] == [0, 0, 1, 1]
    assert 0 <= got[900].score <= 1
    none, flat = toxicity.learn(toxicity.training_rows(table, spark.createDataFrame([], "doc_id long, toxic int")))
    assert none == {} and toxicity.toxicity(table, none, flat).where("predicted = 1").count() == 0


def test_terms_of_any_script_and_length():
    lexicon = toxicity.Lexicon({"дура": 5.0, "馬鹿 ": 5.0, "git ": 5.0})
    assert toxicity.terms_of("馬鹿") == ["馬鹿 "] and toxicity.terms_of("abcde") == ["abcd", "abcde"]
    assert lexicon.features("you git, go")[0] > 1 and lexicon.features("a gitter")[0] == 0
    assert lexicon.features("この 馬鹿")[0] > 1


def test_exception_phrases():
    lexicon = toxicity.Lexicon({"trash": 5.0, "clown": 5.0})
    assert lexicon.features("a trash can, a clown fish") == (0.0, 0.0)
    assert lexicon.features("you trash")[0] > 1


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "␛␛<␛/s><|im_start|>", "", None, "<|␛x|> <turn></turn>", "é\n<|endoftext|> ok", "[INST"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(nasty)] + [(2, 0, None, "solo", "x"), (None, 0, "user", "n", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    path = chat.default_tokenizer()
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table, path), path).collect()}
    text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows[: len(nasty)])
    loss = "".join(t or "" for i, t in enumerate(nasty) if i % 2)
    assert got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (len(nasty), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].turns_sha256 == hashlib.sha256(b"\nsolo\n").hexdigest() and None in got
    for t in nasty:
        safe = chat.escaped(t or "")
        assert chat.unescaped(safe) == (t or "") and not chat.CONTROL.search(safe)


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(2, 90):
        v = rng.normal(size=d)
        rows += [(10 * d, v.tolist()), (10 * d + 1, (v + 0.02 * rng.normal(size=d) * np.linalg.norm(v) / d).tolist()), (10 * d + 2, (-v).tolist())]
    rows += [(None, rows[0][1]), (20, rows[0][1])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == 10 * (r.vec_id // 10) and r.n_links >= 1 for r in got if r.vec_id is not None and r.vec_id % 10 < 2)
    assert all(r.component_id == r.vec_id and r.n_links == 0 for r in got if r.vec_id is None or r.vec_id % 10 == 2)


def test_tables_and_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)  # so that lengths get tables, and buckets and groups are cut
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 24))
    x = np.concatenate([base, *(base[:20] + 0.07 * rng.normal(size=(20, 24)) for _ in range(6)), base[0] + 0.02 * rng.normal(size=(60, 24))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    pairs = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found = sum(r.n_links for r in got.values())
    assert 0.95 * 2 * len(pairs) <= found <= 2 * len(pairs)


def test_sketches_bound_the_cosine():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 33)) ** 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    made, error = embeddings.sketch(x)
    near = made[:, 8:].view(np.int8) * made[:, :4].copy().view("<f4")
    assert (np.abs(near @ near.T - x @ x.T) <= error[:, None] + error + error[:, None] * error + 1e-5).all()


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(120, 32))
    near = base[:20].repeat(4, 0) + 0.08 * rng.normal(size=(80, 32))
    vectors = [v.tolist() for v in np.concatenate([base, near])] + [base[5].tolist(), [0.0] * 32, None, [], [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0]]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, key string, table int")
    got = {r.vec_id: r for r in embeddings.near_vectors(table).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in enumerate(vectors[:201])}
    pairs = [(i, j) for i in good for j in good if i < j and good[i] @ good[j] >= 0.9]
    found = sum(r.n_links for r in got.values())
    assert found >= 0.95 * 2 * len(pairs) and found <= 2 * len(pairs)
    want = groups_of(pairs, got)
    assert all(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in got)
    assert all(got[i].n_links == 0 for i in range(201, 207))
    assert embeddings.near_vectors(table.where("vec_id < 0")).count() == 0


def test_contamination_blocks_agree(spark, corpus):
    rng = random.Random(9)
    items = [(1, " ".join(corpus[70][1].split()[20:45])), (2, "É x-y " + sentence(rng, 30)), (3, corpus[75][1].split()[0]), (4, None), (5, "!!"), (1, "again " + sentence(rng, 12)), (None, corpus[60][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontamination.contamination(docs(spark, corpus), bench).collect()
    parts = decontamination.contamination(docs(spark, corpus), bench, block_bytes=200).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words)
    assert sorted(whole, key=key) == sorted(parts, key=key)
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for r in whole:
        text = next(t for i, t in corpus if i == r.doc_id)
        w, hit, owners = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    owners |= own - {None}
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(owners), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()


def test_contamination_takes_one_worker_a_task(spark, corpus):
    bench = spark.createDataFrame([("1", corpus[2][1])], "item_id string, text string")
    plan = decontamination.contamination(docs(spark, corpus), bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_workers_let_go_what_other_operators_hold(monkeypatch):
    gone = []
    monkeypatch.setattr("loomcast.llm.common._HELD", {})
    hold("packing", lambda: gone.append("packing"))
    assert list(lean(lambda batches: batches, "packing")(iter([1, 2]))) == [1, 2] and not gone
    assert list(lean(lambda batches: batches)(iter([3]))) == [3] and gone == ["packing"]


def test_packing_is_whole(spark, corpus):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    table = docs(spark, [(i, t) for i, t in corpus if i is not None and i != 83] + [(500, "word " * 9000)])
    got = packing.pack_documents(table, path, with_ids=True).collect()
    coder, ids = Tokenizer.from_file(path), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(ids.setdefault(r.doc_id, []))
        assert zlib.crc32(r.ids) == r.ids_crc32
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    for r in table.collect():
        assert ids[r.doc_id] == coder.encode(r.text or "", add_special_tokens=False).ids + [1]
    size = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == size.get(r.sequence_id, 0)
        size[r.sequence_id] = r.offset + r.length
    assert max(size.values()) <= 2048
    assert sum(2048 - n for n in size.values() if n & (n - 1)) <= 2048 * 8


def test_chunks_encode_as_whole_texts():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    odd = ["a　b c\x85d\x1ce <|endoftext|>x", "", " ", "İΣΑΣ é é don't 12,3 q\r\n\tz  k", "ﬁ Å ½ ̈́ ÀÖ, ß.", "naïve. Naïve, NAÏVE"]
    coder = Tokenizer.from_file(path)
    got = packing.ChunkEncoder(path).encode(odd)
    assert [x.tolist() for x in got] == [coder.encode(t, add_special_tokens=False).ids for t in odd]


def test_other_vocabularies_take_the_plain_way():
    from pathlib import Path

    from tokenizers import Tokenizer

    path = str(Path(packing.default_tokenizer()).with_name("byte_bpe_50k.json"))
    coder, mine = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    texts = ["Two Words. And, more\n\nwords", " x  y", ""]
    assert mine.whole and not packing.ChunkEncoder(packing.default_tokenizer()).whole
    assert [x.tolist() for x in mine.encode(texts)] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_equals_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # so that groups are cut into blocks
    rows = [(i, t) for i, t in corpus if i != 83]
    got = by_id(jaccard.near_duplicates(docs(spark, rows)))
    sets = {i: shingles(t) for i, t in rows if i is not None}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = groups_of(pairs, sets)
    for i in sets:
        assert got[i].class_id == want[i]
        assert got[i].n_links == sum(i in p for p in pairs)
    assert jaccard.near_duplicates(docs(spark, rows).where("doc_id < 0")).count() == 0


def test_overlaps_by_product_and_by_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, 40)).astype(np.uint64) << np.uint64(2) for _ in range(150)]
    got = jaccard.overlaps(sets)
    for i in range(0, 150, 7):
        for j in range(150):
            assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_forest_shortens_prefixes_for_low_thresholds(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):  # pairs of Jaccard about 0.5
        base = sentence(rng, 120, 10**6).split()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:80] + sentence(rng, 40, 10**6).split()))]
    sets = {i: shingles(t) for i, t in rows}
    want = {(i, i + 1) for i in range(0, 120, 2) if len(sets[i] & sets[i + 1]) >= 0.45 * len(sets[i] | sets[i + 1])}
    assert len(want) == 60
    table = docs(spark, rows)
    classes = jaccard.signatures(table).selectExpr("doc_id as rep", "1L as copies", "labels")
    links, depth = jaccard.forest_links(table, classes, 0.45, 0.9)
    assert depth < jaccard.DEPTH and links.count() >= 0.9 * 120
    first = jaccard.verified_links(table, classes, 0.45, jaccard.DEPTH)
    assert first.count() < 0.9 * 120  # the full depth does not do
    assert jaccard.found(0.8, jaccard.DEPTH) >= jaccard.RECALL > jaccard.found(0.5, 7)


def test_nodes_are_runs_of_sorted_labels():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, (200, 8)).astype(np.uint64)
    packed_ = np.column_stack([(labels[:, 4 * i : 4 * i + 4] << np.array([48, 32, 16, 0], np.uint64)).sum(1, dtype=np.uint64) for i in range(2)])
    tree, ids = np.zeros(200, np.uint64), rng.permutation(200)
    for depth in (8, 5, 4, 1):
        first, a, b = jaccard.tied(tree, packed_, ids, depth)
        least = {}
        for row, i in sorted(zip(map(tuple, labels[:, :depth].tolist()), ids.tolist()), key=lambda x: x[1]):
            least.setdefault(row, i)
        assert sorted(ids[first].tolist()) == sorted(least.values())
        assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} == {(i, least[tuple(labels[r, :depth].tolist())]) for r, i in enumerate(ids.tolist())} - {(i, i) for i in range(200)}


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog and then runs far away into the deep green wood " * 3
    rows = [
        (1, f"Alpha beta gamma delta epsilon\nshort\n{long}one"), (2, f"alpha BETA gamma, delta epsilon!\nshort\n{long}two\nkeep this line here for good"),
        (3, None), (4, ""), (5, "unique words stand in this very line\n\n"), (2, f"alpha BETA gamma, delta epsilon!\nshort\n{long}two\nkeep this line here for good"),
        (None, "a line of a document without number"), (7, "a line of a document without number"),
    ]
    got = {}
    for r in lines.dedup_lines(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].text == rows[0][1]
    assert [r.text for r in got[2]] == ["short\nkeep this line here for good"] * 2
    assert (got[3][0].text, got[4][0].text, got[5][0].text) == (None, "", rows[4][1])
    assert (got[None][0].text, got[7][0].text) == (rows[6][1], "")
    assert set(got[1][0].asDict()) == {"doc_id", "text", "lang", "start", "items", "__lines", "__removed"}
    assert lines.dedup_lines(docs(spark, rows).where("doc_id < 0")).count() == 0


def test_lines_meet_beside_a_foreign_hub(spark, monkeypatch):
    # one bucket: 1 is far from all, 2 and 3 and 5 and 6 are near, 4 is a stranger, 7 is near 2 but much longer
    base = 0x0123456789ABCDEF
    sims = {1: base ^ 0xFFFFF0, 2: base, 3: base ^ (7 << 30), 4: base ^ (0x3FFF << 46), 5: base ^ (0x7FFFFFF << 30), 6: base ^ (0x7FFFFFF << 30) ^ 2, 7: base, 8: base}  # 8 has other word pairs
    met = spark.createDataFrame([(9, i, s, 0 if i != 8 else -1, 400 if i == 7 else 100) for i, s in sims.items()], "key long, h1 long, sim long, duo long, chars int")
    none = spark.createDataFrame([], "node long, component long")
    for size in (1000, 2):
        monkeypatch.setattr(lines, "BUCKET_ROWS", size)
        assert sorted(tuple(r) for r in lines.open_pairs(met, none).collect()) == [(3, 2), (6, 5)]
        joined = spark.createDataFrame([(2, 2), (3, 2)], "node long, component long")
        assert [tuple(r) for r in lines.open_pairs(met, joined).collect()] == [(6, 5)]


def test_large_buckets_lose_nothing(spark, monkeypatch):
    rng = random.Random(8)
    sims = [rng.getrandbits(62) for _ in range(12)]
    sims += [s ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for s in sims for _ in range(4)]
    classes = spark.createDataFrame([(30, i, s, 5, 200) for i, s in enumerate(sims)], "n int, h1 long, sim long, duo long, chars int")
    want = {(i, j) for i in range(60) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= 4}
    assert {(r.h1, r.other) for r in lines.met_rows(classes, [0]).collect()} >= want  # four bits leave two of six blocks alone
    monkeypatch.setattr(lines, "ALL_PAIRS", 1)
    rows = lines.met_rows(classes, [0])
    none = spark.createDataFrame([], "node long, component long")
    found = lines.open_pairs(rows.where("kind = 1").select("key", "h1", "sim", "duo", "chars"), none)
    assert {tuple(r) for r in found.collect()} >= want


def test_near_lines_leave_their_bucket_in_linear_numbers(spark, monkeypatch):
    rng = random.Random(18)
    base = rng.getrandbits(62)
    sims = [base ^ (1 << rng.randrange(62)) for _ in range(60)]
    classes = spark.createDataFrame([(30, i, s, 5, 200) for i, s in enumerate(sims)], "n int, h1 long, sim long, duo long, chars int")
    want = {(i, j) for i in range(60) for j in range(i)}
    none = spark.createDataFrame([], "node long, component long")
    for all_pairs, some_pairs in ((64, 1 << 16), (1, 1 << 16), (1, 1)):
        monkeypatch.setattr(lines, "ALL_PAIRS", all_pairs)
        monkeypatch.setattr(lines, "SOME_PAIRS", some_pairs)
        rows = lines.met_rows(classes, [0]).collect()
        pairs = [(r.h1, r.other) for r in rows if r.kind == 0]
        left = spark.createDataFrame([r[1:] for r in rows if r.kind == 1], "key long, h1 long, other long, sim long, duo long, chars int")
        found = {tuple(r) for r in lines.open_pairs(left.drop("other"), none).collect()}
        assert found | set(pairs) == want and len(rows) <= 60 * lines.PAIRS * (1 + lines.PAIRS_EACH) / 2
        assert len(pairs) <= 60 * lines.PAIRS // 2
    # a pair that two lines' SimHashes make in all block pairs leaves once
    monkeypatch.setattr(lines, "ALL_PAIRS", 64)
    assert lines.met_rows(classes.where("h1 < 2").withColumn("sim", F.lit(base)), [0, 1]).count() == 1


def test_few_near_lines_leave_a_crowded_bucket_as_pairs(spark):
    # strangers that share two blocks, more than ALL_PAIRS of them, and three near pairs
    rng = random.Random(29)
    mask = lines.masks(0)[0]
    free = [b for b in range(62) if not mask >> b & 1]
    sims = [rng.getrandbits(62) & ~mask for _ in range(150)]
    classes = [(30, i, s, rng.getrandbits(62), 200) for i, s in enumerate(sims)]
    classes += [(30, 150 + i, s ^ (1 << free[0]) ^ (1 << free[1]), duo, 200) for i, (*_, s, duo, _) in enumerate(classes[:3])]
    rows = lines.met_rows(spark.createDataFrame(classes, "n int, h1 long, sim long, duo long, chars int"), [0]).collect()
    assert {(r.h1, r.other) for r in rows if r.kind == 0} >= {(150, 0), (151, 1), (152, 2)}
    assert not [r for r in rows if r.kind == 1]


def test_pairs_of_one_group_are_not_all_verified(spark, monkeypatch):
    # two groups of lines alike and strangers that are near both by their hashes; all pairs are given
    rng = random.Random(37)
    bases = [[f"{k}w{rng.randrange(10**6)}" for _ in range(20)] for k in range(2)]
    texts = []
    for i in range(40):
        line = list(bases[i % 2])
        line[rng.randrange(20)] = f"other{i}"
        texts.append(" ".join(line))
    texts += [sentence(rng, 20, 10**6) for _ in range(2)]
    norm = spark.createDataFrame(list(enumerate(texts)), "h1 long, norm string")
    pairs = spark.createDataFrame([(i, j, rng.randrange(30)) for i in range(42) for j in range(i)], "h1 long, other long, bits long")
    seen, verify = [], lines.verified

    def counted(t, some):
        seen.append(some.distinct().count())
        return verify(t, some)

    monkeypatch.setattr(lines, "verified", counted)
    links = [lines.stored(spark.createDataFrame([(2 + i, i) for i in range(0, 38, 1) if i % 10 < 2], "a long, b long"), "test-links")]
    groups = {r.node: r.component for r in lines.in_turns(norm, pairs, links).collect()}
    assert groups == {i: i % 2 for i in range(40)}
    # pairs between the two groups are all compared (400), and with the strangers (81), but not the 380 within one
    assert sum(seen) <= 400 + 81 + 120


def test_pairs_are_trimmed_together():
    rng = random.Random(19)
    rows = []
    for i in range(200):
        x = "".join(rng.choice("abcé") for _ in range(rng.choice([0, 3, 30, 700])))
        at, cut = rng.randrange(len(x) + 1), rng.randrange(4)
        y = x[:at] + rng.choice(["", "d", "ab"]) + x[at + cut :] if i % 3 else "".join(rng.choice("abcé") for _ in range(rng.randrange(40)))
        rows.append((i, -i, x, y))
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["h1", "other", "mine", "theirs"])
    got = {r["h1"]: r for out in lines.trimmed(iter([batch])) for r in out.to_pylist()}
    for i, _, x, y in rows:
        most = int(max(len(x), len(y)) * 0.2 + 1e-9)
        d = edit_distance(x, y) if i % 3 == 0 or max(len(x), len(y)) < 60 else 3
        assert d > most or i in got
        if i in got and (got[i]["mine"], got[i]["theirs"]) != ("", "") and max(len(x), len(y)) < 60:
            assert edit_distance(got[i]["mine"], got[i]["theirs"]) == d


def test_lines_are_hashed_by_their_words():
    texts = ["The  quick\n\nbrown; FOX\n", "", "the Quick\nÉté 12\nfox brown", "été, 12"]
    got = [tuple(x.tolist() for x in lines.hashed_lines(p)) for p in lines.segments(texts)]
    assert len(got) == 1
    owner, line, h1, h2, chars, n, sim, duo = got[0]
    assert list(zip(owner, line)) == [(0, 0), (0, 2), (2, 0), (2, 1), (2, 2), (3, 0)]
    assert chars == [9, 9, 9, 6, 9, 6] and n == [2] * 6
    assert h1[0] == h1[2] and h1[3] == h1[5] and h1[1] != h1[4] and sim[1] == sim[4] and duo[1] != duo[4] and len(set(h1)) == len(set(h2)) == 4


def test_letter_counts_part_strangers_only(spark):
    rng = random.Random(23)
    texts = ["".join(rng.choice("abcde  fgh2") for _ in range(rng.randrange(30, 70))) + "x" for _ in range(60)]
    for base in texts[:30]:
        edited = list(base)
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], ["z"], [edited[at], "k"]])
        texts.append("".join(edited) + "y")
    *_, chars, n, sim, duo, count0, count1 = (x for p in lines.segments(texts) for x in lines.hashed_lines(p, counted=True))
    counts = np.column_stack([count0, count1]).view(np.uint64)
    norm = [" ".join(re.findall("[a-z0-9]+", t)) for t in texts]
    assert [len(x) for x in norm] == chars.tolist()
    parted = 0
    for i in range(len(norm)):
        for j in range(i):
            most = int(max(len(norm[i]), len(norm[j])) * 0.2 + 1e-9)
            if not lines.counts_allow(counts[i : i + 1], counts[j : j + 1], np.array([most]))[0]:
                parted += 1
                assert edit_distance(norm[i], norm[j]) > most
    assert parted > 1000
    # other letters are counted too, if all versions of Unicode know them
    *_, count0, count1 = lines.hashed_lines([(0, 0, "größe straße über allen\nгоры и долины\n漢字 漢字")], counted=True)
    assert ((count0 != 0) | (count1 != 0)).tolist() == [True, True, False]
    *_, count0, count1 = (x for p in lines.segments(texts) for x in lines.hashed_lines(p, counted=True))
    # lines that the letters part leave no pair, though their SimHashes are the same
    rows = [(9, 1, 7, 7, 40, int(count0[0]), int(count1[0])), (9, 2, 7, 7, 40, *(x - 2**64 if x >> 63 else x for x in (0x4444444444, 0x4444444444)))]
    classes = spark.createDataFrame(rows, "n int, h1 long, sim long, duo long, chars int, count0 long, count1 long")
    assert lines.met_rows(classes, [0]).count() == 0 and lines.met_rows(classes.drop("count0", "count1"), [0]).count() == 1


def test_long_texts_are_cut_at_line_ends(monkeypatch):
    text = "\n".join(f"line number {i} of a text" for i in range(200))
    whole = lines.hashed_lines(next(lines.segments([text])))
    monkeypatch.setattr(lines, "CHUNK", 300)
    parts = [lines.hashed_lines(p) for p in lines.segments([text])]
    assert len(parts) > 10
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), whole, strict=True))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_by_rows_of_bits():
    rng = random.Random(14)
    for _ in range(150):
        x = [rng.randrange(3) for _ in range(rng.randrange(40))]
        y = list(x) if rng.random() < 0.8 else [rng.randrange(3) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = [rng.randrange(3)] * rng.randrange(3)
        a, b = np.array(x, np.uint32), np.array(y, np.uint32)
        d = edit_distance(x, y)
        s, t = lines.trim(a, b)
        assert edit_distance(x[s], y[t]) == d
        assert [lines.within(a, b, k) for k in range(d + 2)] == [k >= d for k in range(d + 2)]


def test_pairs_are_decided_together(monkeypatch):
    rng = random.Random(15)
    pairs = []
    for i in range(400):
        x = "".join(rng.choice("abcé𝛼"[: 2 + i % 4]) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 128, 200])))
        y = list(x)
        for _ in range(rng.randrange(60)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = [rng.choice("abcdé")] * rng.randrange(3)
        pairs.append((x, "".join(y)) if i % 10 else ("a" * 130, "a" * rng.randrange(200)))
    texts = [lines.codes("".join(c)) for c in zip(*pairs, strict=True)]
    size = [np.array([len(t) for t in c]) for c in zip(*pairs, strict=True)]
    at = [np.cumsum(n) - n for n in size]
    d = np.array([edit_distance(x, y) for x, y in pairs])
    for more in (-1, 0, 1):
        got = lines.edits_within(texts[0], texts[1], at[0], size[0], at[1], size[1], d + more)
        assert (got == (more >= 0)).all()
    # pairs of lines that are not long take no loop of their own
    monkeypatch.setattr(lines, "within", None)
    rows = [(i, -i, x + "z", y + "z") for i, (x, y) in enumerate(pairs)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["h1", "other", "mine", "theirs"])
    got = {tuple(r.values())[:4] for out in lines.trimmed(iter([batch])) for r in out.to_pylist()}
    assert got == {(i, j, "", "") for i, j, x, y in rows if d[i] <= int(max(len(x), len(y)) * 0.2 + 1e-9)}


def test_lines_of_some_edits_meet_as_by_brute_force(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice([2, 3, 5, 7, 9]))) for _ in range(300)]
    texts = []
    for k in range(160):
        line = [rng.choice(vocabulary) for _ in range((8, 12, 20, 40)[k % 4])]
        texts.append(" ".join(line))
        for _ in range(1 + (k % 4 == 3)):  # long lines get two edits
            at = rng.randrange(len(line))
            line[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [line[at], rng.choice(vocabulary)]])
        texts.append(" ".join(line))
    near = [(i, j) for j in range(320) for i in range(j) if min(len(texts[i]), len(texts[j])) >= 0.8 * max(len(texts[i]), len(texts[j]))]
    near = [(i, j) for i, j in near if j == i + 1 or len(set(texts[i].split()) & set(texts[j].split())) >= 4]
    want = {j for i, j in near if edit_distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j]))}
    assert len(want) > 100
    got = {r.doc_id for r in lines.dedup_lines(docs(spark, list(enumerate(texts)))).where("__removed = 1").collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_more_partitions_for_fewer_words():
    assert lines.partitions(6) > lines.partitions(12) > lines.partitions(20)
    assert sorted(sum(lines.rounds(), [])) == list(range(lines.partitions(lines.FEW_WORDS)))
    for p in range(lines.partitions(lines.FEW_WORDS)):
        assert len(set(lines.masks(p))) == lines.PAIRS == 15 and all(20 <= m.bit_count() <= 22 for m in lines.masks(p))


def test_common_lines_and_very_long_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 5)  # so that the common line counts as one that a third of all lines are
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(70_000)]
    rows = [(i, f"the common line of all the documents\n{sentence(rng, 30, 10**6)}") for i in range(30)]
    rows += [(40, " ".join(long)), (41, " ".join([*long[:500], "other", *long[501:]]))]
    got = by_id(lines.dedup_lines(docs(spark, rows)))
    assert [got[i]["__removed"] for i in range(30)] == [0] + [1] * 29
    assert (got[40]["__removed"], got[41]["__removed"]) == (0, 1)


def test_passages(spark, corpus):
    got = by_id(passages.near_passages(docs(spark, [(i, t) for i, t in corpus if i != 83])))
    for i in range(75, 80):
        assert any(p.s <= 72 and p.e >= 128 for p in got[i].passages), got[i]
        assert got[i].class_id == 75
    assert all(got[i].class_id == 60 and got[i].n_passages for i in range(60, 75))
    assert all(got[i].n_passages == 0 and got[i].class_id == i for i in range(60))
    assert all(got[i].n_passages == 0 for i in (80, 81, 82, 84))
    assert passages.enough() == 2


def test_edited_passages_are_found(spark):
    rng = random.Random(31)
    rows = []
    for k in range(60):  # an 80-word passage, its copy with one word changed, and a clean document
        passage = sentence(rng, 80, 10**6).split()
        other = list(passage)
        other[rng.randrange(80)] = "changed"
        for j, p in enumerate((passage, other, [])):
            rows.append((3 * k + j, f"{sentence(rng, 70, 10**6)} {' '.join(p)} {sentence(rng, 70, 10**6)}"))
    got = by_id(passages.near_passages(docs(spark, rows)))
    found = sum(got[3 * k].n_passages == 1 == got[3 * k + 1].n_passages and got[3 * k + 1].class_id == 3 * k for k in range(60))
    assert found >= 0.9 * 60
    assert all(got[3 * k + 2].n_passages == 0 for k in range(60))


def test_passages_meet_among_variants(spark):
    rng = random.Random(32)
    rows = []
    for k in range(40):  # 1 and 3 hold a variant that is not near enough, 2 and 4 the passage
        passage = sentence(rng, 64, 10**6).split()
        variant = list(passage)
        variant[20], variant[40] = "one", "two"
        for j, p in enumerate((variant, passage, variant, passage)):
            rows.append((4 * k + j, f"{sentence(rng, 60, 10**6)} {' '.join(p)} {sentence(rng, 60, 10**6)}"))
    got = by_id(passages.near_passages(docs(spark, rows)))
    assert sum(got[4 * k + 3].class_id in (4 * k, 4 * k + 1) and got[4 * k + 1].n_passages == 1 for k in range(40)) >= 0.9 * 40


def test_passages_meet_between_strangers_of_one_line(spark):
    rng = random.Random(33)
    rows = []
    for k in range(40):  # 1 and 3 hold a passage of 50 words; 0 and 2 its middle of 45, too short to be one
        passage = sentence(rng, 50, 10**6).split()
        for j, p in enumerate((passage[2:47], passage, passage[2:47], passage)):
            rows.append((4 * k + j, f"{sentence(rng, 60, 10**6)} {' '.join(p)} {sentence(rng, 60, 10**6)}"))
    got = by_id(passages.near_passages(docs(spark, rows)))
    found = sum(got[4 * k + 3].class_id == 4 * k + 1 and got[4 * k + 1].n_passages == 1 == got[4 * k + 3].n_passages for k in range(40))
    assert found >= 0.95 * 40, found
    assert all(got[4 * k + j].n_passages == 0 for k in range(40) for j in (0, 2))


def test_all_pairs_of_a_key_are_tied(monkeypatch):
    doc = np.array([1, 1, 2, 3, 3, 4, 5, 6, 1, 2, 9])
    key = np.array([7] * 8 + [8, 8, 9], np.uint64)
    records = [key, doc, *(np.arange(11) for _ in range(3))]
    more, first = passages.ties(records)
    assert more.tolist() == list(range(8))
    places = lambda got: set(zip(got[4].tolist(), got[5].tolist(), strict=True))
    assert places(first) == {(0, i) for i in range(2, 8)} | {(i, i + 1) for i in (1, 2, 4, 5, 6)} | {(8, 9)}
    rest = [x[:8] for x in records]
    want = {(a, b) for a in range(8) for b in range(8) if doc[a] < doc[b]}
    bits = np.zeros((8, 4), np.uint64)

    def other(alone, group, content, every=bits, nearest=None):
        found = passages.open_ties(rest, np.array(alone, bool), np.array(group), np.array(content, np.uint64), bits, every, nearest)
        return set().union(*map(places, found))

    for size in (1 << 20, 1):
        monkeypatch.setattr(passages, "OPEN_TIES", size)
        assert other([1] * 8, [0] * 8, range(8)) == want
        # records 2 to 4 are in one group: these are not tied again
        assert other([1, 1, 0, 0, 0, 0, 1, 1], [0, 0, 5, 5, 5, 6, 0, 0], range(8)) == want - {(2, 3), (2, 4)}
        # records 2, 5 and 7 are copies, of which one meets the others
        assert other([1] * 8, [0] * 8, [0, 1, 2, 3, 4, 2, 6, 2]) == {(2, 5), (2, 7)} | {(a, b) for a, b in want if not {5, 7} & {a, b}}
        # record 6 has eleven tokens in every window that no other has
        many = bits.copy()
        many[6, 1] = 2047
        assert other([1] * 8, [0] * 8, range(8), many) == {(a, b) for a, b in want if 6 not in (a, b)}
        few = bits.copy()
        few[:, 0] = [15, 0, 7, 7, 7, 3, 7, 7]  # what each lacks least is record 5, or 1
        assert other([1] * 8, [0] * 8, range(8), few, 1) == {(0, 5), (1, 5), (1, 2), (1, 3), (1, 4), (1, 6), (1, 7)}


def test_sketches_tell_near_windows():
    rng = np.random.default_rng(8)
    t = passages.MIN_TOKENS
    x = rng.integers(0, 2**63, 3 * t).astype(np.uint64)
    y = np.r_[x[:t], rng.integers(0, 2**63, 2 * t).astype(np.uint64)]
    y[20:25] = 0  # five tokens differ
    low = np.array([0, t, 0, 2 * t])
    for high in (low, np.array([0, t, 2 * t, 2 * t])):
        (c, any_, every), (c2, any2, every2) = passages.sketches(x, low, high), passages.sketches(y, low, high)
        lacking = np.bitwise_count(every & ~any2).sum(1)
        assert lacking[0] <= 5 and lacking[1] > 20 and (c != c2).all()
        assert not np.bitwise_count(every & ~any_).any() and len(set(c.tolist())) == len(set(zip(low, high, strict=True)))
    assert passages.sketches(np.tile(x, 2), low + 3 * t, low + 3 * t)[0].tolist() == passages.sketches(x, low, low)[0].tolist()


def test_records_of_texts_that_repeat_themselves():
    words = np.full(1000, 7, np.uint64)
    for key, own, place, low, high in passages.joint_windows([words, words[:60]], 2):
        assert len(key) <= 1000 // passages.MARGIN + 2 and len(set(key.tolist())) == 1
        covered = [(int(o), w) for o, a, b in zip(own, low, high, strict=True) for w in range(a, b + 1)]
        assert covered == [(0, w) for w in range(1000 - passages.MIN_TOKENS + 1)] + [(1, w) for w in range(60 - passages.MIN_TOKENS + 1)]
        assert all(a <= p < a + passages.MIN_TOKENS for a, p in zip(low, place, strict=True))


def test_compact_windows_are_cartesian_nodes():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 2**62, 300).astype(np.uint64)
    own, place, low, high, token, context = next(passages.compact_windows([tokens[:40], tokens]))
    from loomcast.llm.common import mix64

    with np.errstate(over="ignore"):
        h = mix64(tokens + np.uint64(0x9E3779B97F4A7C15))
    t = passages.MIN_TOKENS
    want = {}
    for s in range(len(tokens) - t + 1):
        c = s + int(np.argmin(h[s : s + t]))
        want.setdefault(c, []).append(s)
    assert set(own.tolist()) == {1}
    assert {(p, a, b) for p, a, b in zip(place.tolist(), low.tolist(), high.tolist(), strict=True)} == {(c, min(s), max(s)) for c, s in want.items()}


def test_texts_are_hashed_together(monkeypatch):
    rng = random.Random(12)
    texts = [None, "", "a", "a b c d", "a b c d e", " \n ", "ÉÉ é\ud800 x", *(f" {sentence(rng, rng.randrange(40))}\n" for _ in range(300)), sentence(rng, 3000)]
    want = [common.shingle_hashes(common.word_hashes(t.encode("utf-8", "surrogatepass")), passages.SHINGLE) if t else np.zeros(0, np.uint64) for t in texts]
    calls = []
    monkeypatch.setattr(common, "word_spans", lambda raw, spans=common.word_spans: calls.append(raw) or spans(raw))
    got = passages.token_lists(texts)
    assert len(got) == len(texts) and all(x.dtype == y.dtype and (x == y).all() and len(x) == len(y) for x, y in zip(got, want, strict=True))
    assert len(calls) == 1
    monkeypatch.setattr(passages, "JOINED", 100)
    assert all(len(x) == len(y) and (x == y).all() for x, y in zip(passages.token_lists(texts), want, strict=True))
    assert passages.token_lists([]) == []


def test_chains_of_a_passage_repeated_often():
    # under two hashes, one window of document 1 meets twenty of document 2, either way round
    got = np.array([(1, 2, k, k, 5 + k, 100 * i + 5 + k, 0, 100 * i, 10, 100 * i + 10) for k in range(2) for i in range(20)], np.int64).T
    want = [(1, 2, 5, 6, 100 * i + 5, 100 * i + 6) for i in range(20)]
    assert sorted(zip(*(x.tolist() for x in passages.chained(list(got), 2)), strict=True)) == want
    back = [got[i] for i in (0, 1, 2, 3, 5, 4, 7, 6, 9, 8)]
    want = [(1, 2, x, y, 5, 6) for *_, x, y in want]
    assert sorted(zip(*(x.tolist() for x in passages.chained(back, 2)), strict=True)) == want
    assert not len(passages.chained([x[:20] for x in got], 2)[0])


def test_verified_accepts_what_reaches_the_threshold():
    rng = np.random.default_rng(7)
    for _ in range(200):
        x = rng.integers(0, 2**31, 300).astype(np.uint32)
        y = np.r_[rng.integers(0, 2**31, 90), x[100:176], rng.integers(0, 2**31, 90)].astype(np.uint32)
        at = 90 + rng.integers(0, 72)
        y[at : at + 5] = rng.integers(0, 2**31, 5)  # one changed word, five tokens: 71 / 81 of them are common
        assert len(list(passages.verified(x, y))) == 1


def test_verified_finds_parts():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**31, 300).astype(np.uint32)
    y = np.r_[rng.integers(0, 2**31, 50), x[100:180], rng.integers(0, 2**31, 50)].astype(np.uint32)
    assert list(passages.verified(x, y)) == [(100, 180, 50, 130)]


def test_pairs_with_too_few_matches_are_left_at_once(monkeypatch):
    rng = np.random.default_rng(31)
    x = rng.permutation(1000).astype(np.uint32)[:46]
    for misses, found in ((5, 1), (6, 0)):  # 41 of 46 are the least with a share of 8 of 9
        y = x.copy()
        y[10 : 10 + misses] += 5000
        assert sum(1 for _ in passages.stretches(np.isin(x, y))) == found
        assert (np.count_nonzero(passages.among(x, y)) >= passages.LEAST_MATCHES) == found
    for n, m in ((0, 5), (5, 0), (40, 90), (90, 40)):
        a, b = rng.integers(0, 50, n), rng.integers(0, 50, m)
        assert (passages.among(a, b) == np.isin(a, b)).all()
    monkeypatch.setattr(passages, "stretches", None)  # it is not even asked for
    assert list(passages.verified(x, y + np.uint32(9000))) == []


def test_empty_tables(spark, corpus):
    none = docs(spark, corpus).where(F.lit(False))
    assert substrings.repeated_bytes(none).count() == 0
    assert passages.near_passages(none).count() == 0
    assert secrets.secret_spans(none).count() == 0
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0
    assert toxicity.toxicity(none, *toxicity.learn(toxicity.training_rows(none, spark.createDataFrame([], "doc_id long, toxic int")))).count() == 0
    path = chat.default_tokenizer()
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(turns, path), path).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs(spark, corpus), bench).where("contaminated").count() == 0
