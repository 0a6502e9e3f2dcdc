"""Operators over the whole corpus against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quillmend.llm import edit_embedding, minhash_forest, sentence_spans, simhash_windows, warc

FOLDER = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, key string, node string, words string"


def words(text):
    return regex.sub(r"[^\p{L}\p{M}\p{N}_]+", " ", (text or "").lower()).split()


def grams(w):
    return [tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))] if w else []


def brute_links(texts):
    """Links and least linked id of each text, by an inverted index."""
    sets = {i: frozenset(grams(words(t))) for i, t in texts.items()}
    owners = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            owners[g].append(i)
    links, parent = Counter(), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for g in s for j in owners[g] if j != i)
        for j, n in common.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return links, {i: root(i) for i in sets}


def test_similarity_join_finds_every_link(spark):
    rows = entry.queries()["op10_minhash_forest"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    links, roots = brute_links(texts)
    assert {r.doc_id: (r.n_links, r.class_id) for r in rows} == {i: (links[i], roots[i]) for i in texts}


def test_similarity_join_in_blocks(spark, monkeypatch):
    """A group larger than a block, with exact copies: all pairs are still judged."""
    monkeypatch.setattr(minhash_forest, "BLOCK_NODES", 8)
    monkeypatch.setattr(minhash_forest, "VERIFIED_NODES", 8)
    monkeypatch.setattr(minhash_forest, "VERIFIED_COLUMNS", 16)
    base = [f"w{k}" for k in range(200)]
    texts = {k: " ".join(base[:190] + [f"v{k % 30}"] + base[190:]) for k in range(60)} | {100: "other words here", 101: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = minhash_forest.similarity_join(docs).collect()
    links, roots = brute_links(texts)
    got = {r.doc_id: (r.n_links, r.class_id) for r in rows}
    assert got == {i: (links[i], roots[i]) for i in texts}


def test_similarity_join_on_odd_rows(spark):
    rows = [(1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (3, "One two", "a", "b", "c"), (4, "one, TWO!", "a", "b", "c"),
            (4, "one, TWO!", "a", "b", "c"), (None, "x " * 4000, None, None, None)]
    got = minhash_forest.similarity_join(spark.createDataFrame(rows, EXTRA)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in got) == [
        (0, 0, 0, 1), (1, 1, 1, 2), (2, 1, 1, 2), (3, 3, 2, 3), (4, 3, 2, 3), (4, 3, 2, 3)]
    assert minhash_forest.similarity_join(spark.createDataFrame([], EXTRA)).count() == 0


def test_similarity_join_of_rows_without_ids(spark):
    """Null ids have links, ids may be texts, and ids that repeat name different texts."""
    base = [f"w{k}" for k in range(120)]
    near = [" ".join(base[:60] + [f"v{k}"] + base[60:]) for k in range(4)]
    docs = spark.createDataFrame([(None, near[0]), ("b", near[1]), (None, near[2]), (None, near[2]), ("a", "far away"), ("a", near[3]), (None, None)],
                                 "doc_id string, text string")
    got = sorted((r.doc_id or "-", r.class_id or "-", r.n_links, r.n_copies) for r in minhash_forest.similarity_join(docs).collect())
    assert got == [("-", "-", 0, 1), ("-", "a", 4, 1), ("-", "a", 4, 2), ("-", "a", 4, 2), ("a", "a", 0, 1), ("a", "a", 4, 1), ("b", "a", 4, 1)]
    kept = sorted((r.doc_id or "-", r.text) for r in minhash_forest.first_of_classes(docs).collect() if r.text)
    assert kept == [("a", "far away"), ("a", near[3])]
    nameless = docs.withColumn("doc_id", docs.doc_id.substr(9, 1)).withColumn("doc_id", F.nullif("doc_id", F.lit("")))
    assert sorted(r.n_links for r in minhash_forest.similarity_join(nameless).collect()) == [0, 0, 4, 4, 4, 4, 4]
    assert minhash_forest.first_of_classes(nameless).count() == 3


def test_subtries_are_searched_from_the_full_depth_up():
    """Against all pairs: the same components; pairs already connected are not compared."""
    rng = np.random.default_rng(4)
    n, below = 400, 3
    rest = np.sort(rng.integers(0, 3, (n, below), dtype=np.uint32).view([("", np.uint32)] * below), axis=0).view(np.uint32).reshape(n, below)
    group = np.zeros(n, np.int64)
    sig = rng.integers(0, 4, (n, 8), dtype=np.uint8)
    compared = []

    def alike(a, b):
        compared.append(len(a))
        return (a == b).mean(1) >= 0.5

    same = np.zeros(n, np.int64)
    root = minhash_forest.searched(sig, rest, group, same, np.ones(n, bool), alike)
    i, j = np.triu_indices(n, 1)
    ok = (sig[i] == sig[j]).mean(1) >= 0.5
    assert (root == minhash_forest.spanning(i[ok], j[ok], n)).all() and sum(compared) < len(i) / 2
    copies = np.zeros((n, 8), np.uint8)
    compared.clear()
    assert not minhash_forest.searched(copies, rest, group, same, np.ones(n, bool), alike).any() and sum(compared) < 3 * n
    # Across the sides of a pair of blocks alone.
    side = np.arange(n) % 2
    root = minhash_forest.searched(sig, rest, group, side, np.zeros(n, bool), alike)
    ok &= side[i] != side[j]
    assert (root == minhash_forest.spanning(i[ok], j[ok], n)).all()


def test_recall_of_the_forest(spark):
    """Pairs just above the threshold, each alone: nearly all are found."""
    rng = random.Random(8)
    rows = []
    for k in range(600):
        words = [f"{rng.randrange(10 ** 6)}" for _ in range(104)]
        # Five of a hundred runs of five words change with a word; two words make 10 of 110.
        other = words[:30] + ["x"] + words[31:70] + ["y"] + words[71:]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = minhash_forest.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_links == 1 for r in got) >= 0.995 * len(got)


def test_leaks_equal_brute_force(spark):
    rows = entry.queries()["op6_simhash_windows"](spark, FOLDER).collect()
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    places = defaultdict(list)
    for i, w in items.items():
        for o, g in enumerate(grams(w)):
            places[g].append((i, o))
    expected = {}
    for doc in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        w = words(doc.text)
        for p, g in enumerate(grams(w)):
            for i, o in places.get(g, ()):
                start = max(0, min(p - o, len(w) - len(items[i])))
                a, b = Counter(grams(w[start:start + len(items[i])])), Counter(grams(items[i]))
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if sim >= 0.8:
                    expected[doc.doc_id, i] = max(sim, expected.get((doc.doc_id, i), 0))
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == pytest.approx(expected)


def test_leaks_on_odd_rows(spark):
    item = " ".join(f"w{k}" for k in range(40))
    changed = item.replace("w20", "other")
    docs = spark.createDataFrame([
        (1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (3, f"before {item.upper()} after", "a", "b", "c"),
        (3, f"before {item.upper()} after", "a", "b", "c"), (4, f"x y z {changed[:-4]} end", "a", "b", "c"),
        (5, "far " * 3000 + item, "a", "b", "c"), (6, "nothing of that kind in here", "a", "b", "c"), (7, "Tiny ITEM", "a", "b", "c")], EXTRA)
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "tiny item")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start) for r in simhash_windows.find_leaks(docs, items).collect())
    assert got == [(3, 1, 1), (3, 1, 1), (3, 2, 1), (3, 2, 1), (5, 1, 3000), (5, 2, 3000), (7, 5, 0)]
    kept = simhash_windows.decontaminate(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6] and kept.columns == docs.columns
    assert simhash_windows.find_leaks(docs, items.limit(0)).count() == 0
    assert simhash_windows.find_leaks(docs.limit(0), items).count() == 0


def test_repeated_spans(spark):
    passage = "This passage has a few words in it. It goes on for a while, as passages do! Does it end?"
    docs = spark.createDataFrame([
        (2, f"Second. {passage} Own ending of two.", "a", "b", "c"), (1, f"First. {passage}", "a", "b", "c"),
        (3, None, "a", "b", "c"), (4, "", "a", "b", "c"), (5, f"{passage}\n{passage}", "a", "b", "c"), (1, f"First. {passage}", "a", "b", "c"),
        (None, passage, None, None, None)], EXTRA)
    rows = sentence_spans.remove_repeated_spans(docs).collect()
    got = sorted((r.doc_id or 99, r.text, r.n_removed) for r in rows if r.text is not None)
    assert got == [(1, f"First. {passage}", 0), (1, f"First. {passage}", 0), (2, "Second. Own ending of two.", 3), (4, "", 0),
                   (5, "", 6), (99, "", 3)]
    assert [r.n_sentences for r in rows if r.doc_id == 3] == [0]
    assert sentence_spans.remove_repeated_spans(docs.limit(0)).count() == 0


def test_repeated_spans_among_rows_without_ids(spark):
    passage = "This passage has a few words in it. It goes on for a while, as passages do! Does it end?"
    rows = [(None, f"Own {k}. {passage}", "d") for k in range(40)] + [(None, f"Own 3. {passage}", "d")]
    got = spark.createDataFrame(rows, "doc_id string, text string, doc string")
    kept = sentence_spans.remove_repeated_spans(got).collect()
    # One text keeps the passage; here it is in at most two rows, as one text is there twice.
    assert sum(r.n_removed == 0 for r in kept) in (1, 2) and sum(r.n_removed in (3, 4) for r in kept) >= 39 and kept[0].doc == "d"
    named = sentence_spans.remove_repeated_spans(spark.createDataFrame([*rows, ("x", passage, "d"), ("a", passage, "d")], got.schema)).collect()
    assert [r.doc_id for r in named if r.n_removed == 0] == ["a"]
    many = spark.range(10_000).selectExpr("CAST(NULL AS STRING) AS doc_id", f"concat('Own ', id, '. {passage}') AS text")
    assert sentence_spans.remove_repeated_spans(many).where("n_removed = 0").count() == 1


def test_archives_are_read_piece_by_piece(monkeypatch):
    import gzip

    def record(k, block):
        return f"WARC/1.1\r\nWARC-Type: response\r\nX-Record-Key: {k}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    blocks = [b"", b"x" * 5000, b"WARC/1.1\r\n\r\n", bytes(range(256)) * 9, b"\r\n\r\n"]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "PIECE_BYTES", size)
        for data in (b"".join(map(record, range(5), blocks)), gzip.compress(b"".join(map(record, range(5), blocks))),
                     b"".join(gzip.compress(record(k, b)) for k, b in enumerate(blocks))):
            assert [(f["x-record-key"], b) for f, b in warc.records_in(data)] == [(str(k), b) for k, b in enumerate(blocks)]
    assert list(warc.records_in(b"")) == []
    for broken in (b"junk", record(1, b"abc")[:-6], gzip.compress(record(1, b"abc" * 99))[:-20]):
        with pytest.raises(ValueError):
            list(warc.records_in(broken))


def test_archives(spark, tmp_path):
    body = "<p>same</p>" * 20
    rows = [(3, "http://c", body), (1, "http://a", body), (2, "http://b\r\nX: y", body + "WARC/1.1\r\n\r\n"), (4, None, None), (5, "u", "short"),
            (6, "u", "short"), (1, "http://a", body), (None, "u", body), (7, "ü", "ü" * 100)]
    records = spark.createDataFrame(rows, "id long, uri string, payload string")
    got = warc.deduplicate(records, str(tmp_path / "archives")).collect()
    by = {(r.record_key, r.record_type): r for r in got}
    assert len(got) == len(rows)
    assert by["3", "revisit"].refers_to == "1" and by[None, "revisit"].refers_to == "1"
    assert by["3", "revisit"].payload_bytes == len(body) and by["1", "response"].payload_digest == hashlib.sha256(body.encode()).hexdigest()
    assert by["3", "revisit"].payload_digest == by["1", "response"].payload_digest
    assert by["4", "response"].payload_bytes == 0 and by["5", "response"] and by["6", "response"]
    assert by["7", "response"].payload_bytes == 200
    read = warc.read_archives(spark, str(tmp_path / "archives")).collect()
    assert {bytes(r.payload).decode() for r in read if r.record_type == "response"} == {body, rows[2][2], "", "short", "ü" * 100}
    assert all(r.payload == b"" for r in read if r.record_type == "revisit")
    assert warc.deduplicate(records.limit(0), str(tmp_path / "none")).count() == 0


def test_walks_follow_their_definition():
    """The table of moves against a walk that is made step by step."""
    from quillmend.llm.common import mixed

    text = edit_embedding.code_points("some text, walked one step at a time")
    symbols = ((text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(int)
    step, came = 0, [0]
    for s in symbols:
        while True:
            bit = int(mixed(np.array([s * edit_embedding.PERIOD + step % edit_embedding.PERIOD + 1], np.uint64))[0] >> np.uint64(63))
            step += 1
            if bit:
                break
        came.append(step)
    assert edit_embedding.arrivals([text])[0].tolist() == came
    many = [edit_embedding.code_points("ab" * n) for n in (0, 1, 700, 3)]
    assert [a.tolist() for a in edit_embedding.arrivals(many)] == [edit_embedding.arrivals([t])[0].tolist() for t in many]


def test_edited_texts_and_their_likeness(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in entry.queries()["op9_edit_embedding"](spark, FOLDER).collect()}
    order = sorted(docs)
    assert sorted(rows) == order
    for k, i in enumerate(order):
        own, after = docs[i], docs[order[(k + 1) % len(order)]]
        half = len(own) // 2
        changed = own[:len(own) - half] + after[:half]
        assert rows[i].n_chars == len(own) and rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (rows[i].near_next == 1) >= (own == after)
    near = [rows[i].near_edited for i in order if len(docs[i]) > 500]
    assert 0.4 < np.mean(near) < 0.6 and np.mean([rows[i].near_next for i in order]) < 0.05
    # One edit in a hundred characters keeps fingerprints alike.
    text = docs[max(docs, key=lambda i: len(docs[i]))][:2000]
    little = re.sub(r"(?s)(.{100}).", r"\1", text)
    a, b = edit_embedding.fingerprints([edit_embedding.code_points(text), edit_embedding.code_points(little)])
    assert edit_embedding.likeness(a, b) > 0.6


@pytest.mark.parametrize("spread, least", [(True, 0.995), (False, 0.98)])
def test_recall_of_the_bands(spread, least):
    """Pairs of likeness just above 0.8, with edits all over and with edits in the first quarter alone."""
    rng = random.Random(6)
    met = tried = 0
    texts = []
    for _ in range(1500):
        text = "".join(rng.choices("abcdefghij klmnop", k=600))
        other = list(text)
        for _ in range(rng.randrange(3, 20)):
            at = rng.randrange(len(other) if spread else 150)
            other[at] = rng.choice(["", "x", "yz"])
        texts += [text, "".join(other)]
    prints = edit_embedding.fingerprints([edit_embedding.code_points(t) for t in texts])
    raw = [edit_embedding.parsed(edit_embedding.shown(p)) for p in prints]
    for k in range(0, len(raw), 2):
        a, b = raw[k:k + 1], raw[k + 1:k + 2]
        if 0.8 <= edit_embedding.likeness(prints[k], prints[k + 1]) < 0.86:
            tried += 1
            (keys, told), (others, told_too) = (edit_embedding.bands(np.array(x)) for x in (a, b))
            met += bool(set(keys[told].tolist()) & set(others[told_too].tolist()))
    assert tried > 50 and met >= least * tried, (met, tried)


def test_fingerprints_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (5, "same text", "a", "b", "c"), (5, "same text", "a", "b", "c"),
                                  (None, "last", None, None, None)], EXTRA)
    rows = edit_embedding.near_classes(edit_embedding.fingerprint_documents(docs)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert got[None].edited_sha256 == hashlib.sha256(b"la").hexdigest()
    assert got[2].near_class == 1
    empty = edit_embedding.fingerprint_documents(docs.limit(0))
    assert edit_embedding.near_classes(empty).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "surrogates", "sentencepiece"]
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    _, roots = brute_links(texts)
    left = stages["near_duplicates"](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(roots.values())) and left.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = {r.doc_id for r in stages["quality"](spark, docs, FOLDER).collect()}
    assert sum(labels[i] == (i in good) for i in labels) / len(labels) > 0.97
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x", "en", "s", 1)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, FOLDER)
        assert {r.doc_id for r in out.collect()} == {1, 2, None} or name == "near_duplicates"
    assert stages["near_duplicates"](spark, odd.limit(0), FOLDER).count() == 0


def test_pipeline_end_to_end(spark):
    """The rows of run() against what each stage must have done, judged by brute force."""
    import public_tokenizers
    import sentencepiece

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and all((r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source) for r in rows)
    # Quality: of the labelled documents, hardly a bad one is left, and good ones are there if no near copy is.
    kept = {r.doc_id for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in kept) <= 0.03 * len(kept)
    # Near duplicates: no two originals that are left are linked.
    texts = {i: docs[i].text for i in kept}
    links, _ = brute_links(texts)
    assert not any(links[i] for i in kept)
    # Decontamination: no whole benchmark item is in what is left.
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for text in texts.values():
        flat = " ".join(words(text))
        assert not any(item and f" {item} " in f" {flat} " for item in items)
    # Personal data: addresses and long hexadecimal secrets of the originals are gone; clean texts are as they were.
    changed = 0
    for r in rows:
        original = docs[r.doc_id].text
        for found in re.findall(r"[\w.+-]+@[\w-]+\.[\w.-]*\w|\b[0-9a-f]{32,}\b", original):
            assert found not in r.text
        changed += r.text != original
        if not re.search(r"[0-9@]|(?i:token|secret|password|passwd|pwd|key)|[a-fA-F]{32}|\\b[A-ZА-ЯΑ-Ω]\\w*[. ]+[A-ZА-ЯΑ-Ω]|[хо]сп|κύρι", original):
            assert r.text == original
        assert r.n_chars == len(r.text)
    assert 0 < changed < len(rows)
    # Encoding: as the library does.
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows[::7]:
        ids = sp.encode(r.text, add_bos=True, add_eos=True)
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
