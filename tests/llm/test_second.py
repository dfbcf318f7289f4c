"""op5, op6, op7 and op9 against plain Python."""

import gzip
import hashlib
import random
import zlib

import public_tokenizers
import pytest

from palimpsest.llm import chat, common, packing, toxicity, warc

PAGES = [
    (1, "http://a", "x" * 1500, 1),
    (2, "http://b", "x" * 1500, 1),
    (2, "http://b", "x" * 1500, 1),
    (3, None, "x" * 1500, 1),
    (4, "http://d", "short", 1),
    (5, "http://e", "short", 1),
    (6, "http://f\r\nInjected: 1", None, 1),
    (7, "http://g", "é" * 700 + "\r\n\r\n" + "y" * 300_000, 1),
    (None, "http://h", "z" * 2000, 1),
]


def test_warc_query(spark, sf_dir):
    table = common.read(spark, sf_dir, "pages").collect()
    largest = {}
    for r in table:
        largest[r.html or ""] = max(r.page_id, largest.get(r.html or "", r.page_id))
    got = {r.page_id: r for r in warc.query(spark, sf_dir).collect()}
    assert len(got) == len(table)
    for r in table:
        raw = (r.html or "").encode()
        to = largest[r.html or ""] if len(raw) >= 1000 and largest[r.html or ""] != r.page_id else None
        own = got[r.page_id]
        assert (own.payload_bytes, own.payload_digest, own.record_type, own.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to)


def test_warc_odd_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    folder = common.shared_dir(spark)
    made = warc.write(pages, folder)
    got = warc.read(made, folder).collect()
    assert len(got) == len(PAGES) and sum(r.records for r in made.collect()) == len(PAGES)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == [(-1, "response", None, 2000), (1, "revisit", 3, 1500), (2, "revisit", 3, 1500), (2, "revisit", 3, 1500), (3, "response", None, 1500), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (7, "response", None, 301_404)]
    assert next(r for r in got if r.page_id == 7).payload.decode() == PAGES[7][2]
    assert warc.read(warc.write(pages.limit(0), folder), folder).count() == 0


def test_warc_members_and_damage():
    first = warc.record(1, "u", b"hello", None, hashlib.sha1(b"hello").hexdigest())
    raw = gzip.compress(first) + gzip.compress(warc.record(2, "u", b"hello", 1, hashlib.sha1(b"hello").hexdigest()))
    assert [(r["page_id"], r["payload"]) for r in warc.parse(raw)] == [(1, b"hello"), (2, None)]
    for bad in (gzip.compress(first.replace(b"hello", b"hullo")), gzip.compress(first)[:-12], gzip.compress(first[:-3])):
        with pytest.raises((ValueError, zlib.error)):
            warc.parse(bad)


def test_toxicity(spark, sf_dir):
    got = {r.doc_id: r for r in toxicity.query(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    labels = common.read(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in labels if got[r.doc_id].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y]
    assert sum(pairs) / len(pairs) > 0.85
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.9


def test_toxicity_locates_and_takes_odd_rows(spark):
    rng = random.Random(1)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "magna"]
    line = lambda bad: " ".join(rng.choices(words, k=8) + ["vile"] * bad) + "."
    rows = [(i, " ".join(line(i % 3 == 0 and k == 2) for k in range(5)), i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(1000, None, 1), (1001, "", 1), (None, "vile", 1), (1002, "vile " * 30_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(y), 1) for i, _, y in rows] + [(0, 0, 1), (None, 1, 1), (5000, 1, 1), (1, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text, bad in rows:
        assert (got[i].score >= 0.5) == bad
        assert ["vile" in text[s.begin : s.end] for s in got[i].offending] == [True] * bad
    assert got[1000].score == got[1001].score < 0.5 < got[1002].score and got[None].score > 0.5
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i, r in got.items() if r.score < 0.5}
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), nothing).count() == 0 and 0 < toxicity.score(docs, nothing).first().score < 0.5


def brute_scores(texts, toxic, weight, others):
    """Scores by the model as its docstring tells it, in plain Python: features by hand, and the same optimiser on dense rows of floats."""
    import math
    import re

    def bags(text):
        out = []
        for part in re.split(r"[.!?\n。！？]", text.lower()):
            if part:
                found = {w for w in re.findall(r"[^\W\d_]+", part)}
                out.append(found | {"^" + w[:4] for w in found if len(w) > 4})
        return out or [set()]

    docs = [bags(t) for t in texts]
    has = [set().union(*d) for d in docs]
    n = [sum(1 for y in toxic if y == k) for k in (0, 1)]
    words = []
    for w in sorted(set().union(*has)):
        c = [sum(1 for h, y in zip(has, toxic, strict=True) if y == k and w in h) for k in (0, 1)]
        share = sum(c) / sum(n)
        if sum(c) >= toxicity.LEAST_DOCS and abs(c[1] / n[1] - c[0] / n[0]) / math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-9) >= toxicity.TOLD:
            words.append(w)
    total, sentences = sum(weight), sum(map(len, docs))
    base = (sum(w * y for w, y in zip(weight, toxic, strict=True)) + 0.5) / (total + 1)
    x, b = {w: 0.0 for w in words}, math.log(base / (1 - base)) - math.log(sentences / len(docs))
    m, v, mb, vb = dict(x), dict(x), 0.0, 0.0
    for t in range(1, toxicity.PASSES + 1):
        g, gb = {w: toxicity.DECAY / len(docs) * x[w] for w in words}, 0.0
        for d, y, wt in zip(docs, toxic, weight, strict=True):
            p = [1 / (1 + math.exp(-max(-30, min(30, sum(x.get(w, 0.0) for w in bag) + b)))) for bag in d]
            clean = math.prod(1 - q for q in p)
            for bag, q in zip(d, p, strict=True):
                blame = wt / total * (-clean / max(1 - clean, 1e-9) if y else 1.0) * q
                gb += blame
                for w in bag & x.keys():
                    g[w] += blame
        for w in words:
            m[w], v[w] = 0.9 * m[w] + 0.1 * g[w], 0.999 * v[w] + 0.001 * g[w] ** 2
            x[w] -= toxicity.STEP * (m[w] / (1 - 0.9**t)) / (math.sqrt(v[w] / (1 - 0.999**t)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b -= toxicity.STEP * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return [1 - math.prod(1 - 1 / (1 + math.exp(-(sum(x.get(w, 0.0) for w in bag) + b))) for bag in bags(t)) for t in others]


def test_toxicity_query_by_brute_force(spark, sf_dir):
    """All scores of op6 equal those of a plain Python model, trained on the same rows."""
    docs = {r.doc_id: r.text or "" for r in common.read(spark, sf_dir, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in common.read(spark, sf_dir, "labels").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = sorted(i for i in labels if i in docs)
    assert len(rows) <= 2 * toxicity.PER_CLASS and len(set(labels.values())) == 2
    everything = sorted(docs)
    counts = {k: sum(1 for y in labels.values() if y == k) / max(1, sum(1 for i in rows if labels[i] == k)) for k in (0, 1)}
    want = dict(zip(everything, brute_scores([docs[i] for i in rows], [labels[i] for i in rows], [counts[labels[i]] for i in rows], [docs[i] for i in everything]), strict=True))
    got = toxicity.query(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 0.02 and (r.predicted == (want[r.doc_id] >= 0.5) or abs(want[r.doc_id] - 0.5) < 0.02)


def ids_of(text):
    return packing.word_ids(public_tokenizers.path("word_bpe_49k.json")).lib.encode(text, add_special_tokens=False).ids + [1]


def check_packing(table, got, capacity=4096):
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for name, text in table:
        ids = ids_of(text or "")
        for k, r in enumerate(sorted(pieces[name], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert (r.piece, r.start) == (k, k * capacity) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        assert r.start + r.length == len(ids)
    total = 0
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
    return len(bins), total


def test_packing(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in common.read(spark, sf_dir, "documents").collect()]
    n, total = check_packing(table, packing.query(spark, sf_dir).collect())
    assert n <= -(-total // 4096) + 2
    rows = [(1, None, 1), (2, "", 1), (3, "Ünï ΑΣ　x <|endoftext|>y \x1c z", 1), (4, "long words " * 5000, 1), (5, "a" * 20_000, 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing([r[:2] for r in rows], packing.places(packing.pack(docs, path)).collect())
    twice = packing.places(packing.pack(docs.union(docs), path)).count()
    assert twice == 2 * packing.places(packing.pack(docs, path)).count()
    assert packing.places(packing.pack(docs.limit(0), path)).count() == 0


def test_best_fit_is_tight():
    rng = random.Random(3)
    sizes = [rng.randint(1, 60) for _ in range(2000)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= -(-sum(sizes) // 100) + 1


MEAN = "</s>[INST] ok [/INST]"


def test_chat_query(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in common.read(spark, sf_dir, "conversations").collect()] + [(-1, 0, "user", MEAN), (-1, 1, "assistant", MEAN)]
    got = {r.conv_id: r for r in chat.query(spark, sf_dir).collect()}
    want = {}
    for c, _, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(b) for _, b in turns)


def test_chat_escapes_and_odd_rows(spark):
    own = chat.chat(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice([*chat.CONTROL, "\\", "<", "[", "<\\/s>", "x"]) for _ in range(6))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
        turns = [("user", text), ("tool " + text, ""), ("assistant", text), ("assistant", "")]
        ids, mask, shown = own.encode(turns)
        back, loss, again = own.decode(ids, mask.tolist())
        assert (back, "".join(loss), again) == (turns, text, shown)
    rows = [(1, 0, None, None, 1), (1, None, "user", "first", 1), (2, 0, "assistant", "é" * 50_000, 1), (2, 0, "assistant", "é" * 50_000, 1), (None, 0, "user", "x", 1)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int"), public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert (got[1].n_turns, got[2].n_turns, got[2].loss_chars, got[None].n_turns) == (2, 2, 100_000, 1)
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\n\n").hexdigest()
