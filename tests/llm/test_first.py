"""op1, op2 and op4 against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from palimpsest.llm import common, hilbert, sentencepiece_codec, sketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, IDS string, sketch int, range int"
ROWS = [
    (3, "the cat sat on the mat and then the cat went home", "en", "a", 10, "x", 1, 2),
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, "y", 1, 2),
    (5, "the cat sat on the mat and then the cat went home", "en", "a", 10, "x", 1, 2),
    (8, "été ▁ \U0001f600 <s>  two  blanks \n", "fr", "b", 7, "x", 1, 2),
    (9, "word " * 9000 + "end", "de", "a", 45003, "x", 1, 2),
    (9, "word " * 9000 + "end", "de", "a", 45003, "x", 1, 2),
    (None, "no id here", "de", "a", 3, "x", 1, 2),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sentencepiece_equals_the_library(spark, sf_dir, docs):
    lib = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model")).lib
    got = {r.doc_id: r for r in sentencepiece_codec.query(spark, sf_dir).collect()}
    table = common.read(spark, sf_dir, "documents").collect()
    assert len(got) == len(table)
    for row in table:
        ids = lib.encode(row.text or "", add_eos=True)
        own = got[row.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256, own.n_bytes) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)), len((row.text or "").encode()))
    for row in sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect():
        text = next(r[1] or "" for r in ROWS if r[0] == row.doc_id)
        assert row.ids == lib.encode(text, add_eos=True) and row.decoded == lib.decode(row.ids)
        assert row.begins == [0, *row.ends[:-1]] and row.ends[-1] == len(text.encode())
        for i, a, b in zip(row.ids[:-1], row.begins, row.ends, strict=False):
            if not lib.is_byte(i):
                assert text.encode()[a:b].decode().replace(" ", "▁") in ("▁" + text.replace(" ", "▁")) and lib.id_to_piece(i).endswith(text.encode()[a:b].decode().replace(" ", "▁"))


def test_sentencepiece_empty_table(spark, docs):
    assert sentencepiece_codec.encode_decode(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_normaliser_with_a_compiled_map_equals_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    texts = ["ＡＢ ①  ﬁ ½", " lead and trail ", "", "   ", "　a b▁ c", "ẛ̣ İ"]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        for flag in (True, False):
            lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=flag, remove_extra_whitespaces=flag, escape_whitespaces=flag)
            model = sentencepiece_model_pb2.ModelProto()
            model.ParseFromString(lib.serialized_model_proto())
            own = object.__new__(sentencepiece_codec.Codec)
            own.spec, own.chars, own.user, own.plain = model.normalizer_spec, sentencepiece_codec.CharsMap(model.normalizer_spec.precompiled_charsmap), [], False
            for text in texts:
                out, at = own.normalize(text)
                assert out.decode() == lib.normalize(text)
                assert len(at) == len(out) + 1 and all(a <= b for a, b in zip(at, at[1:], strict=False)) and at[-1] <= len(text.encode())


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch_query(spark, sf_dir):
    table = sorted(common.read(spark, sf_dir, "documents").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in sketch.query(spark, sf_dir).collect()}
    assert len(got) == len(table)
    error = []
    for k, row in enumerate(table):
        text, after = row.text or "", table[(k + 1) % len(table)].text or ""
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        own = got[row.doc_id]
        assert (own.n_chars, own.edited_sha256) == (n, sha(edited))
        for value, other in ((own.near_edited, edited), (own.near_next, after)):
            a, b = shingles(text), shingles(other)
            error.append(abs(value - (len(a & b) / len(a | b) if a | b else 1)))
    assert sum(error) / len(error) < 0.05 and max(error) < 0.5
    prints = Counter((got[r.doc_id].fingerprint, r.text) for r in table)
    assert len({t for _, t in prints}) == len(prints)


def test_sketch_odd_rows(spark, docs):
    got = sketch.neighbours(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))  # no id here has different texts
    want = sorted((r[0] or -1, r[1] or "", order[(k + 1) % len(order)][1] or "") for k, r in enumerate(order))
    assert sorted((r.doc_id or -1, r.text, r.next_text) for r in got) == want
    assert sketch.neighbours(docs.limit(0)).count() == 0
    one = sketch.neighbours(docs.filter("doc_id = 3")).collect()
    assert [(r.next_text, r.sketch == r.next_sketch) for r in one] == [(ROWS[0][1], True)]


def spark_hash(spark, texts):
    """Hash of each text's shingles by Spark's function of single values, put together as the sketch does."""
    from pyspark.sql import functions as F

    words = sorted({w for t in texts for w in t.split()})
    code = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    out = []
    for t in texts:
        h = [code[w] for w in t.split()]
        out.append([tuple(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [tuple(h)] if h else [])
    rows = [(i, list(s)) for i, x in enumerate(out) for s in set(x)]
    full = spark.createDataFrame([r for r in rows if len(r[1]) == 5], "i int, h array<long>").select("i", F.xxhash64(*[F.get("h", F.lit(k)) for k in range(5)]).alias("x"))
    short = spark.createDataFrame([r for r in rows if len(r[1]) < 5], "i int, h array<long>").select("i", F.xxhash64("h").alias("x"))
    got = {i: set() for i in range(len(texts))}
    for r in full.union(short).collect():
        got[r.i].add(r.x)
    return got


def brute_sketch(hashes, levels=sketch.LEVELS, keep=sketch.KEEP):
    for level in range(levels + 1):
        kept = sorted(x for x in hashes if x <= 2 ** (64 - level) - 2**63 - 1)
        if level == levels or len(kept) <= keep:
            return level, kept


def made_texts():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    long = [word() for _ in range(6000)]
    texts = ["", "one two", "a b c d e", "word " * 9000, "word " * 18000, "x y " * 700, " ".join(long), " ".join(long[1000:1040]), " ".join(long[2000:2400])]
    return texts + [" ".join(word() for _ in range(n)) for n in (254, 259, 260, 261, 300, 600, 1100, 2500)] + [" ".join(long[:3000] + [word() for _ in range(3000)])]


def test_sketches_by_brute_force(spark):
    texts = made_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    hashes = spark_hash(spark, texts)
    made = common.materialize(sketch.with_sketch(df, "text", "s"))
    got = {r.i: (r.s.level, r.s.kept) for r in made.collect()}
    assert got == {i: brute_sketch(h) for i, h in hashes.items()}
    assert {level for level, _ in got.values()} == set(range(sketch.LEVELS + 1))
    a, b = made.alias("a"), made.alias("b")
    from pyspark.sql import functions as F

    pairs = a.crossJoin(b).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), sketch.likeness(F.col("a.s"), F.col("b.s")).alias("near"), sketch.containment(F.col("a.s"), F.col("b.s")).alias("inside"))
    error = []
    for r in pairs.collect():
        x, y = hashes[r.i], hashes[r.j]
        near = len(x & y) / len(x | y) if x | y else 1.0
        inside = len(x & y) / len(x) if x else None
        if max(len(x), len(y)) <= sketch.KEEP:  # all hashes are there
            assert r.near == near and r.inside == (1.0 if x == y else inside)
        else:
            error.append(abs(r.near - near))
            if r.inside is not None and len(x) >= 30:
                error.append(abs(r.inside - inside) if len(x) >= 300 else 0)
    assert sum(error) / len(error) < 0.01 and max(error) < 0.1
    near = {(r.i, r.j): r for r in pairs.collect()}
    assert near[3, 4].near == near[3, 4].inside == 1.0  # the same shingle, however often
    assert near[0, 0].near == 1.0 and near[0, 1].near == 0.0
    assert near[8, 6].inside == 1.0 and near[7, 6].inside == 1.0  # short texts within a long one
    assert abs(near[6, len(texts) - 1].inside - 0.5) < 0.05


def test_merged_sketch_is_that_of_the_union(spark):
    texts = made_texts()
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "g int, text string")
    hashes = spark_hash(spark, texts)
    got = {r.g: (r.s.level, r.s.kept) for r in sketch.merge(sketch.with_sketch(df, "text", "s"), ["g"], "s").collect()}
    assert got == {g: brute_sketch(set().union(*[hashes[i] for i in range(len(texts)) if i % 4 == g])) for g in range(4)}


def test_neighbours_split_a_frequent_id(spark):
    """Rows of one id and without one lie in many ranges, and each is still followed by the next."""
    from pyspark.sql import functions as F

    rows = [(7, f"text {k}") for k in range(300)] + [(None, f"none {k}") for k in range(200)] + [(k, "t") for k in range(100)] + [(7, "twice")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    splits = sketch.id_splits(df.withColumn("key", F.coalesce("doc_id", F.lit(sketch._NO_ID))), "key", 16)
    keyed = df.select(F.coalesce("doc_id", F.lit(sketch._NO_ID)).alias("key"), F.xxhash64("text").alias("hashed"))
    sizes = [r["count"] for r in keyed.groupBy(sketch.range_of(F.col("key"), F.col("hashed"), splits).alias("r")).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 100
    order = sorted([(r.key, r.hashed) for r in keyed.collect()])
    at = {(r.doc_id, r.text): r.hashed for r in df.withColumn("hashed", F.xxhash64("text")).collect()}
    text = {h: t for (_, t), h in at.items()}
    want = sorted((text[h], text[order[(k + 1) % len(order)][1]]) for k, (_, h) in enumerate(order))
    assert sorted((r.text, r.next_text) for r in sketch.neighbours(df).collect()) == want


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        ranks, after = hilbert.curve_table(dims)
        found = {}
        for point in range(1 << dims * bits):
            at = [point >> bits * d & (1 << bits) - 1 for d in range(dims)]
            state = index = 0
            for b in reversed(range(bits)):
                cell = sum((x >> b & 1) << d for d, x in enumerate(at))
                index = (index << dims) + ranks[(state << dims) + cell]
                state = after[(state << dims) + cell]
            found[index] = at
        assert sorted(found) == list(range(1 << dims * bits))
        assert all(sum(abs(a - b) for a, b in zip(found[i], found[i + 1], strict=True)) == 1 for i in range(len(found) - 1))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, sf_dir, docs, law):
    table = {r.doc_id: r for r in common.read(spark, sf_dir, "documents").collect()}
    got = hilbert.shards(common.read(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 16, law).collect()
    assert sorted(r.doc_id for r in got) == sorted(table)
    sizes, slots = Counter(), {}
    for r in got:
        raw = (table[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sizes[r.shard] += r.size if law == "bytes" else 1
        slots.setdefault(r.shard, []).append((r.slot, r.curve))
    assert set(sizes) == set(range(16))
    most = 1 if law == "rows" else 2 * max(r.size for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= most
    curve = []
    for s in range(16):
        slots[s].sort()
        assert [x for x, _ in slots[s]] == list(range(len(slots[s])))
        curve += [c for _, c in slots[s]]
    assert curve == sorted(curve)
    odd = hilbert.shards(docs, ["lang", "source", "n_chars"], 3, law).collect()
    assert len(odd) == len(ROWS) and len({(r.shard, r.slot) for r in odd}) == len(ROWS)
    assert hilbert.shards(docs.limit(0), ["lang", "n_chars"], 3, law).count() == 0


def test_whole_text_keys_are_quantised(spark):
    """Keys that begin alike, and dates, have a level of their own where they are frequent enough."""
    import datetime

    rows = [(i, "t", f"https://site{i % 40:02}", datetime.date(2020, 1, 1) + datetime.timedelta(i % 64)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, day date")
    for name, distinct in (("source", 40), ("day", 64)):
        at = hilbert.exact_cuts(df, name, 32)
        order = sorted(r[2 if name == "source" else 3] for r in rows)
        assert at == [order[-(-k * len(order) // 32) - 1] if k * len(order) % 32 else order[k * len(order) // 32 - 1] for k in range(1, 32)]
        levels = {r.level for r in df.select(hilbert.level(df[name], at).alias("level")).distinct().collect()}
        assert len(levels) >= min(distinct, 32) * 3 // 4
    assert hilbert.exact_cuts(df.limit(0), "source", 32) == []


def test_written_shards(spark, tmp_path):
    """All rows and columns, whatever their names, in slot order; a filter on any dimension skips files."""
    import pyarrow.dataset as ds

    rng = random.Random(11)
    rows = [(i, f"text {i}", f"https://site{rng.randrange(64):02}/x", rng.randrange(10**6), 5, "k", 0) for i in range(6000)]
    rows += [(None, None, None, None, 5, "k", 0), (7, "again", "https://site00/x", 3, 5, "k", 0), (7, "again", "https://site00/x", 3, 5, "k", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, shard int, slot string, curve int")
    path = str(tmp_path / "shards")
    hilbert.write_shards(df, path, ["source", "n_chars"], 64)
    got = spark.read.parquet(path)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*df.columns).collect()), key=key) == sorted(rows, key=key)
    counts = [r["count"] for r in got.groupBy("hilbert_shard").count().collect()]
    assert len(counts) == 64 and max(counts) - min(counts) <= 1
    files = list(ds.dataset(path, partitioning="hive").get_fragments())
    for name, low, high in (("source", "https://site20/", "https://site22/~"), ("n_chars", 400_000, 430_000)):
        met = 0
        for f in files:
            stats = [f.metadata.row_group(k).column(df.columns.index(name)).statistics for k in range(f.metadata.num_row_groups)]
            met += any(s.has_min_max and s.min <= high and s.max >= low for s in stats)
        assert met <= 0.35 * len(files), name
    slots = {r.doc_id: (r.shard, r.slot) for r in hilbert.shards(df, ["source", "n_chars"], 64).collect()}
    for f in files:
        rows_ = [slots[r["doc_id"]] for r in f.to_table(columns=["doc_id"]).to_pylist() if r["doc_id"] not in (7, None)]
        assert len({x[0] for x in rows_}) <= 1 and [x[1] for x in rows_] == sorted(x[1] for x in rows_)
