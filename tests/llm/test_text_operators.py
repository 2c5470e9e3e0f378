"""Each text operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm.suffix_kernel import radix_groups
from factloom.llm import chat_format, common, fingerprints, jaccard_join, language_id, media, mixing, piece_codec, queries, suffix_dedup, toxicity, url_rules

from .fixtures import ODD_TEXTS, SCHEMA, clashing, near_copies, odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------ 1 toxicity


def _toxic_corpus(spark, n=600):
    rnd = random.Random(1)
    vocab = [f"plain{i}" for i in range(400)]
    rows = []
    for i in range(n):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(30, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                t[rnd.randrange(len(t))] = rnd.choice(["idiot", "scum", "moron", "trash"])
        rows.append((i, " ".join(t), int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity_held_out(spark):
    df = _toxic_corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit_toxicity(df, df.where(~held).select("doc_id", "toxic"))
    got = toxicity.score_toxicity(df.where(held), model, ["doc_id", "toxic"]).collect()
    right = sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in got)
    assert right >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_odd_input(spark, odd, empty):
    df = _toxic_corpus(spark, 200)
    model = toxicity.fit_toxicity(df, df.select("doc_id", F.when(F.col("doc_id") != 3, F.col("toxic")).alias("toxic")))
    assert toxicity.score_toxicity(clashing(odd).drop("score"), model, ["doc_id", "key", "t", "c0"]).count() == odd.count()
    assert toxicity.score_toxicity(empty, model, ["doc_id"]).count() == 0
    none = toxicity.fit_toxicity(df, df.limit(0).select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score_toxicity(odd, none, ["doc_id"]).collect()} == {0.0}
    one = toxicity.fit_toxicity(df, df.where("toxic = 1").select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score_toxicity(odd, one, ["doc_id"]).collect()} == {1.0}


def test_toxicity_ratios_are_those_of_the_counts(spark):
    """Word and bigram ratios against plain counting, on distinct texts; a held-out word falls back to its stem."""
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choice(["aa", "bb", "cccccc1", "cccccc2", "dd", "idiot"][: 5 + c]) for _ in range(rnd.randint(3, 12))), c) for c in (0, 1) for _ in range(30)]
    pair = toxicity.KneserNeyPair(spark.createDataFrame(rows, "t string, c bigint").repartition(3))
    two, words = [collections.Counter(), collections.Counter()], [t.split() for t, _ in rows]
    for w, (_, c) in zip(words, rows):
        two[c].update(zip(["<s>", *w], w))
    vocab = sorted({x for w in words for x in w})
    stem = {w: w[:5] for w in vocab}
    stems = sorted(set(stem.values()))
    d = toxicity.DISCOUNT
    cont = [{w: sum(1 for p in two[c] if p[1] == w) for w in vocab} for c in (0, 1)]
    p_word = []
    pooled = {s: sum(stem[w] == s for w in vocab) + 1.0 for s in stems}
    mass = sum(pooled.values()) + 1.0
    for c in (0, 1):
        n, kinds = sum(cont[c].values()), sum(v > 0 for v in cont[c].values())
        by_stem = {s: sum(cont[c][w] > 0 for w in vocab if stem[w] == s) for s in stems}
        n_stem = max(sum(by_stem.values()), 1)
        weight = max(d * sum(v > 0 for v in by_stem.values()) / n_stem, toxicity.SHARED / n_stem)
        p_stem = {s: max(by_stem[s] - d, 0) / n_stem + weight * pooled[s] / mass for s in stems}
        p_word.append({w: max(cont[c][w] - d, 0) / n + d * kinds / n * p_stem[stem[w]] / sum(stem[x] == stem[w] for x in vocab) for w in vocab})
    heads = [collections.Counter(), collections.Counter()]
    for c in (0, 1):
        for (a, _), n in two[c].items():
            heads[c][a] += n
    total = [sum(h.values()) for h in heads]

    def ratio(a, w):
        word = np.log(p_word[1][w] / p_word[0][w])
        if not two[0][a, w] + two[1][a, w]:
            return word
        head = np.log((heads[1][a] + toxicity.SHARED * total[1] / sum(total)) / (heads[0][a] + toxicity.SHARED * total[0] / sum(total)))
        share = 1 / (1 + np.exp(-head - word))
        return np.log((max(two[1][a, w] - d, 0) + toxicity.BACKOFF * share) / (max(two[0][a, w] - d, 0) + toxicity.BACKOFF * (1 - share))) - head

    for text in ("idiot aa bb idiot idiot", "cccccc2 dd cccccc1", "bb"):
        w = text.split()
        got = pair.llr(*toxicity.tokens(pa.array([text], pa.large_string())))
        assert np.allclose(got, [ratio(a, b) for a, b in zip(["<s>", *w], w)], atol=1e-5)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """A labelled id that many rows repeat adds no more texts than the bounds; ids need not be numbers."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 20)
    df = _toxic_corpus(spark, 200).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    many = spark.range(500).select(F.lit("d0").alias("doc_id"), F.concat(F.lit("idiot text "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("toxic"))
    known = df.select(F.col("doc_id").alias("l_id"), F.col("toxic").alias("l_toxic"))
    both = df.unionByName(many).unionByName(many)
    sample = toxicity._sample(both.select(F.col("doc_id").alias("d_id"), F.col("text").alias("d_text")), known)
    counts = dict(sample.groupBy("toxic").count().collect())
    assert 0 < counts[0] <= 20 and 0 < counts[1] <= 20 and sample.count() == sample.select("text").distinct().count()
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3000)
    sample = toxicity._sample(both.select(F.col("doc_id").alias("d_id"), F.col("text").alias("d_text")), known)
    assert all(r[0] <= 3000 for r in sample.groupBy("toxic").agg(F.sum(F.octet_length("text"))).select(F.col("sum(octet_length(text))")).collect())
    monkeypatch.undo()
    model = toxicity.fit_toxicity(both, df.select("doc_id", "toxic"))
    assert toxicity.score_toxicity(both, model, ["doc_id"]).count() == 1200


# ------------------------------------------------------------ 2 chat formatting


def test_viterbi_in_blocks_is_exact():
    """Rows of lines, rows in blocks, against all paths."""
    rnd = random.Random(4)
    roles = chat_format.ROLES
    m = chat_format.RoleModel({(r, k): rnd.randint(0, 9) for r in roles for k in range(8)}, {(a, b): rnd.randint(0, 9) for a in roles for b in roles}, {r: rnd.randint(0, 9) for r in roles})
    for _ in range(100):
        rows = [m.emissions([(rnd.choice([None, 0, 1, 2]), rnd.randrange(8), "") for _ in range(rnd.randint(1, 3))], rnd.choice([None, *roles])) for _ in range(rnd.randint(1, 4))]
        flat = [(e, m.step if not k else m.inside[marked]) for r in rows for k, (e, marked) in enumerate(r)]
        step = lambda a, b, into: into[a][b]
        score = lambda p: m.start[p[0]] + sum(step(a, b, n) for a, b, (_, n) in zip(p, p[1:], flat[1:])) + sum(x[s] for (x, _), s in zip(flat, p))
        k = rnd.randint(1, 3)
        blocks = [rows[i : i + k] for i in range(0, len(rows), k)]
        ends = m.chain([m.block_matrix([m.row_matrix(r) for r in b]) for b in blocks])
        path = [s for b, (first, last) in zip(blocks, ends) for r, (x, y) in zip(b, m.trace_rows([m.row_matrix(r) for r in b], first, last)) for s in m.trace_lines(r, x, y)]
        assert score(path) == pytest.approx(max(score(p) for p in itertools.product(range(3), repeat=len(flat))))


def _chat(c, turns, rnd, label=lambda r, t: r):
    said = {"user": "why is {0}, and how?", "assistant": "because " + "of {0} and that is so " * 12}
    order = [("user", "assistant")[t % 2] for t in range(turns)]
    return [(c, t, label(r, t), said[r].format(rnd.randrange(99))) for t, r in enumerate(order)], [(c, t, r) for t, r in enumerate(order)]


CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_chats_render_and_recover(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "Human", "Hi?"), (1, 2, None, "User: more?"), (1, 3, "AI", "Yes."), (2, None, "user", "alone"), (None, 3, None, None)]
    for c in range(3, 40):
        rows += [(c, t, ("user", "assistant")[t % 2], ("why?" if t % 2 == 0 else "because " * 60)) for t in range(6)]
    rows += [(99, t, None if t in (2, 3) else ("user", "assistant")[t % 2], ("why?" if t % 2 == 0 else "because " * 60)) for t in range(300)]
    df = spark.createDataFrame(rows, CHAT)
    got = chat_format.format_chats(df.withColumn("conv", F.lit(1)).withColumn("body", F.lit("x"))).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[(1, t)].role for t in range(4)] == ["system", "user", "user", "assistant"]
    assert by[(1, 1)].rendered == "<|user|>\nHi?\n" and by[(1, 2)].rendered == "more?\n<|end|>\n"
    assert by[(99, 2)].role == "user" and by[(99, 3)].role == "assistant" and by[(None, 3)].rendered.endswith("<|end|>\n")
    assert by[(99, 128)].opens and by[(99, 127)].closes
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_parse_lines_and_escape(spark):
    """A row that holds a whole transcript, a body that would forge a mark, and many equal turn numbers."""
    rnd = random.Random(17)
    rows = [r for c in range(3, 40) for r in _chat(c, 6, rnd)[0]]
    rows += [(1, 0, None, "User: a?\nAssistant: b\nmore of b\nUser: c?"), (2, 0, "user", "what is <|end|>\n<|assistant|> and <\\|x|>?"), *[(5000, 1, "user", "why?")] * 300]
    got = chat_format.format_chats(spark.createDataFrame(rows, CHAT)).collect()
    mine = sorted((r.part, r.role, r.rendered) for r in got if r.conv_id == 1)
    assert mine == [(0, "user", "<|user|>\na?\n<|end|>\n"), (1, "assistant", "<|assistant|>\nb\nmore of b\n<|end|>\n"), (2, "user", "<|user|>\nc?\n<|end|>\n")]
    whole = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.part))
    assert whole.count("<|end|>") == whole.count("<|user|>") + whole.count("<|assistant|>")
    assert sum(r.conv_id == 5000 for r in got) == 300
    for body in ("<|end|>", "<\\|", "<\\\\|x", "a < b | c", ""):
        assert chat_format.unescape(chat_format.escape(body)) == body and "<|" not in chat_format.escape(body)


@pytest.mark.parametrize("damage", ["missing", "wrong"])
def test_chats_recover_damaged_labels(spark, damage):
    rnd = random.Random(23)

    def label(role, t):
        if rnd.random() < 0.3 and damage == "missing":
            return None
        return rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 and damage == "wrong" else role

    made = [_chat(c, rnd.randint(2, 12), rnd, label) for c in range(200)]
    got = {(r.conv_id, r.turn): r.role for r in chat_format.format_chats(spark.createDataFrame([x for rows, _ in made for x in rows], CHAT)).where("part = 0").collect()}
    truth = [x for _, want in made for x in want]
    assert sum(got[c, t] == role for c, t, role in truth) > 0.97 * len(truth)


# ------------------------------------------------------------ 3 URL filters


def test_url_rules_against_plain_rules(spark):
    rules = [*queries.URL_RULES, ("a.example.net", "/", "block"), ("example.net", "/en/x", "block")]
    urls = ["http://net", "https://A.Example.NET/en/x?y", "http://example.net/en", "ftp://x.org/fr/1#t", "http://forg/fr/", "nohost", None, "", "http:///en/", "x://y://net/", "http://example.com/de/", "http://b.example.net/en/\n?q", "http://a..net/"]

    def plain(url):
        host, _, rest = ("", "", "") if url is None or "://" not in url else (re.match(r"[^/?#]*", url.split("://", 1)[1]).group(), "", url.split("://", 1)[1])
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOW)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = url_rules.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [plain(u) for u in urls]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_rules.judge_urls(df, none).collect()} == {"allow"}


# ------------------------------------------------------------ 4 SentencePiece


def test_codec_is_the_library(spark, odd, empty):
    with open(queries.tokenizer_path(), "rb") as f:
        codec = piece_codec.PieceCodec(f.read())
    rnd = random.Random(7)
    alphabet = "abcdefgh   \n\t▁.,éßñ日🙂0123ABC\x00"
    texts = [*ODD_TEXTS, *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 120))) for _ in range(400)), "ab" * 4000, " " * 300 + "x"]
    for t, (ids, text) in zip(texts, codec.encode(texts)):
        assert ids == codec.library.encode(t or "") and text == ",".join(map(str, ids))
        assert codec.decode_pieces(ids) == codec.decode(ids)
    for word in ("international", "zzzzqqqq", "e" * 30):
        symbols = codec.char[[ord(c) for c in word]]
        rows, n = codec.agenda_rows(symbols[None].copy(), np.array([len(word)]))
        assert rows[0][: n[0]].tolist() == codec.agenda_heap(symbols.tolist())
    got = piece_codec.encode_documents(clashing(odd), queries.tokenizer_path(), ["doc_id", "t"], ids=True).collect()
    assert len(got) == odd.count() and all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)
    assert piece_codec.encode_documents(empty, queries.tokenizer_path(), ["doc_id"]).count() == 0


# ------------------------------------------------------------ 5 media columns


def test_media_round_trips():
    rnd = np.random.default_rng(3)
    for h, w in ((1, 64), (7, 5), (3, 1)):
        rgb = rnd.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (media.decode(media.encode_netpbm(rgb)) == rgb).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
        gray = rgb[:, :, 0]
        assert (media.decode(media.encode_netpbm(gray)) == gray).all()
    assert (media.decode(b"P5\n# note\n2 1\n255\nab") == [[97, 98]]).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_mean_area():
    a = np.random.default_rng(0).random((6, 8))
    assert np.allclose(media.area_resize(a, 3, 4), a.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(a, 4, 5).mean(), a.mean())


def test_media_columns(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    for fmt in ("ppm", "bmp"):
        got = media.media_columns(clashing(odd), fmt=fmt, blobs=True).collect()
        assert len(got) == len(rows)
        for src, r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id,)))):
            del src
            back = media.decode(r.media).tobytes()
            assert hashlib.sha256(back).hexdigest() == r.payload_sha256 and len(back) == r.payload_bytes and len(back) % 192 == 0 and len(back) > 0
            assert zlib.crc32(back[-16:]) == r.tail_crc32 and r.media_bytes == len(r.media) and r.tile[:6] == b"\x93NUMPY"
            tile = media.tile_of(r.tile)
            assert tile.shape == media.TILE and r.feature == media.difference_hash(tile) and r.tile_sha256 == hashlib.sha256(r.tile).hexdigest()
            plain = media.area_resize(np.frombuffer(back, np.uint8).reshape(-1, 64, 3).sum(2), *media.TILE)
            assert (tile == plain.round()).all()
    heads = {r.media[:2] for r in media.media_columns(odd, blobs=True).collect()}
    assert heads == {b"P6", b"BM"}
    want = {hashlib.sha256(media.pad((t or "").encode())).hexdigest() for t in ODD_TEXTS}
    assert want <= {r.payload_sha256 for r in media.media_columns(odd).collect()}
    assert media.media_columns(empty).count() == 0


# ------------------------------------------------------------ 6 mixing


def _targets(sizes):
    """The resharing as it is told: caps reached are fixed, the excess goes round again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_targets_and_takes(spark, odd, empty):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), "en", rnd.choice([None, "s0", "s1", "s2", "s3", "s10", "Z"] + ["big"] * 4)) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan_mix(df).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t))
    want = _targets(sizes)
    took = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size and r.size == len(WORD.findall(rows[r.doc_id][1]))
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        took[r.source] += r.taken
    assert all(abs(took[s] - want[s]) <= 40 for s in sizes)
    again = mixing.plan_mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix_documents(clashing(df))
    assert mixed.columns == clashing(df).columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan_mix(odd).count() == odd.count() and mixing.plan_mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_of_repeated_and_null_ids(spark, monkeypatch):
    """The mix takes of each row what the plan gives it; bins do not change the plan; one long document does not spoil a target."""
    rnd = random.Random(31)
    rows = [(rnd.choice([None, None, i, 7]), " ".join(["w"] * rnd.randint(0, 30) + [f"x{i % 150}"]), rnd.choice(["en", None]), rnd.choice(["s0", "s1", None])) for i in range(400)]
    rows += [(1000 + i, " ".join(["w"] * (4000 if i == 3 else 20)), "en", "small") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plan = mixing.plan_mix(df).collect()
    taken, target = collections.Counter(), {}
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(plan) == len(rows) and all(abs(taken[s] - target[s]) <= 31 for s in target if s != "small")
    mixed = mixing.mix_documents(clashing(df)).collect()
    words = collections.Counter()
    for r in mixed:
        words[r.source] += len(WORD.findall(r.text))
    assert words == +taken and len(mixed) == sum(r.copies for r in plan)
    most = collections.Counter(tuple(r) for r in df.collect())
    assert all(n <= 2 * most[k] for k, n in collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in mixed).items())
    monkeypatch.setattr(mixing, "BIN_ROWS", 1)
    monkeypatch.setattr(mixing, "MIN_BITS", 1)
    assert sorted(map(str, mixing.plan_mix(df).collect())) == sorted(map(str, plan))


def test_mixing_meets_the_schedule(spark):
    """Words of each source by time, against the integral of its weight; copies stand apart."""
    rnd = random.Random(13)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 40)), "en", rnd.choice(["s0", "s1", "s2"])) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r for r in mixing.plan_mix(df).collect() if r.copies]
    assert {r.copies for r in got} == {1, 2} and all(len(r.positions) == r.copies and r.position == r.positions[0] for r in got)
    between = 0
    for k, s in enumerate(("s0", "s1", "s2")):
        mine = [r for r in got if r.source == s]
        total = sum(r.taken for r in mine)
        between += 1 < total / mine[0].source_size < 2
        ramp0, ramp1 = mixing.RAMPS[k]
        for t in (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9):
            due = (ramp0 * t + (ramp1 - ramp0) * t * t / 2) / ((ramp0 + ramp1) / 2)
            assert abs(sum(r.size for r in mine for p in r.positions if p <= t) / total - due) <= 80 / total
        assert all(b - a > 0.2 for r in mine if r.copies == 2 for a, b in [r.positions])
    assert between
    # The mix has its copies where the plan says.
    times = sorted((p, r.doc_id) for r in got for p in r.positions)
    assert [r.doc_id for r in mixing.mix_documents(df).collect()] == [i for _, i in times]


def test_word_count(spark, odd):
    got = odd.select("text", mixing.word_count(F.col("text"))).collect()
    assert all(n == len(WORD.findall(t or "")) for t, n in got)


# ------------------------------------------------------------ 7 n-gram Jaccard join


def _shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _components(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for a, b in {(a, b) for v in holders.values() for a, b in itertools.combinations(v, 2)}:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= 75 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str) == _components(rows)


def test_jaccard_open_classes(spark, monkeypatch):
    """A hub far from its family: links that only the bound's shingles find."""
    monkeypatch.setattr(jaccard_join, "ALL_PAIRS", 1)
    monkeypatch.setattr(jaccard_join, "EXPANDED", 3)
    rows = near_copies(3)[:160]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str) == _components(rows)


def test_jaccard_borderline_families(spark, monkeypatch):
    """Families whose members differ by one to three words, so that many links need a shingle or two outside the hub."""
    monkeypatch.setattr(jaccard_join, "ALL_PAIRS", 1)
    rnd = random.Random(41)
    rows = []
    for _ in range(10):
        base = [f"v{rnd.randrange(4000)}" for _ in range(rnd.randint(50, 70))]
        for _ in range(14):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = f"e{rnd.randrange(6)}"
            cut = rnd.choice([0, 0, 2, 5])
            rows.append((len(rows), " ".join(t[cut:])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str) == _components(rows)


def test_jaccard_plans_stay_small(spark, monkeypatch):
    """The driver holds all stages of a plan that wait for nothing at once, each with its tasks: no step may pile them up."""
    monkeypatch.setattr(jaccard_join, "ALL_PAIRS", 1)
    monkeypatch.setattr(jaccard_join, "EXPANDED", 3)
    plans, write = [], jaccard_join.checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(df)

    monkeypatch.setattr(jaccard_join, "checkpoint", noted)
    rows = near_copies(3)[:160]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    jaccard_join.jaccard_components(df)
    assert len(plans) > 25 and max(plans) <= 8


def test_checkpoints_trim_the_driver(spark, monkeypatch):
    """What planning leaves of native memory goes back to the system at each checkpoint (a JVM of 17.0.9 or later on Linux)."""
    trimmed = []
    monkeypatch.setattr(common, "trim_driver", lambda s, f=common.trim_driver: trimmed.append(f(s)))
    assert common.checkpoint(spark.range(3)).count() == 3 and trimmed == [True]


def test_jaccard_odd_input(spark, odd, empty):
    got = jaccard_join.jaccard_components(clashing(odd)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _components([(r[0], r[1]) for r in odd_rows()])
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 300)], "a bigint, b bigint")
    got = {r.node: r.root for r in jaccard_join.connected_components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


# ------------------------------------------------------------ 8 suffix-array deduplication


def _kept(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if seen.setdefault(w, (i, s)) < (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _passages(seed):
    rnd = random.Random(seed)
    alphabet = "abcdé fgh"
    passages = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(60, 400))) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "x" * 1000), (4, "x" * 500), (5, "ab" * 400), (6, "b" + "ab" * 300)]
    for i in range(7, 100):
        parts = (rnd.choice(passages)[rnd.randint(0, 30) :] if rnd.random() < 0.5 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(rnd.randint(1, 8)))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("hot,sampled,frequent", [(512, 100, 1000), (3, 100, 1000), (512, 1, 10), (10**9, 1, 10**5)])
def test_suffix_dedup(spark, monkeypatch, hot, sampled, frequent):
    """With first digits compared in one place, dealt out by window, and dealt out by run from the beginning."""
    for name, value in (("HOT", hot), ("SAMPLED", sampled), ("FREQUENT", frequent)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = _passages(5)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == _kept(rows)


def test_radix_groups_are_the_equal_windows():
    rnd = np.random.default_rng(2)
    raw = rnd.integers(97, 99, 4000).astype(np.uint8)
    raw[2000:2600] = raw[100:700]
    start = rnd.permutation(len(raw) - 99)
    given = (start % 2).astype(np.uint64)
    at, group = radix_groups(raw, start, given)
    want, found = collections.defaultdict(set), collections.defaultdict(set)
    for i, s in enumerate(start):
        want[raw[s : s + 100].tobytes(), s % 2].add(i)
    for i, g in zip(at, group):
        found[g].add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_suffix_dedup_odd_input(spark, odd, empty):
    rnd = random.Random(0)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    more = spark.createDataFrame([(3, long, "en", "s"), (3, long, "en", "s"), (None, long, "en", "s"), (4, "z" + long, "en", "s")], SCHEMA)
    df = odd.unionAll(more)
    got = suffix_dedup.remove_repeats(clashing(df), carry=["doc_id", "key", "kept"], texts=False).collect()
    assert len(got) == df.count()
    # Equal rows stand for one document; a null id comes last.
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in got if r.n_bytes in (300, 301)}
    assert removed == {(3, 300): 0, (None, 300): 300, (4, 301): 300}
    assert suffix_dedup.remove_repeats(empty).count() == 0


# ------------------------------------------------------------ 9 language ID


def _speak(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n)).capitalize()


def test_language_held_out(spark, odd, empty):
    rnd = random.Random(5)
    tongues = {"aa": ["the", "on", "er", "an"], "bb": ["sch", "ein", "ung", "ü"], "cc": ["que", "le", "é", "ou"]}
    rows = [(i, _speak(rnd, s, rnd.randint(20, 300)), lang, "s") for i, (lang, s) in enumerate(list(tongues.items()) * 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language_id.fit_language(df.where(~held))
    got = language_id.predict_language(df.where(held), model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    seen = {(r.t, r.lang_pred, r.score) for r in language_id.predict_language(odd.select("*", F.col("text").alias("t")), model, ["t"]).collect()}
    assert {(None, "und", 0.0), ("", "und", 0.0), (" \n\t ", "und", 0.0), ("🙂 🙂", "und", 0.0)} <= seen and len(seen) >= 10
    assert language_id.predict_language(empty, model, ["doc_id"]).count() == 0
    nothing = language_id.fit_language(df.limit(0))
    assert {r.lang_pred for r in language_id.predict_language(odd, nothing, ["doc_id"]).collect()} == {"und"}


def test_phrases_are_greedy_longest_matches():
    rnd = random.Random(8)
    text = "".join(rnd.choice("abc ") for _ in range(300))
    model = language_id.LanguageModel({"x": text})
    for _ in range(30):
        t = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 200)))
        n, at = 0, 0
        while at < len(t):
            k = at + 1
            while k < len(t) and t[at : k + 1] in text:
                k += 1
            n, at = n + 1, k
        count, size = model.phrases([t])
        # A character outside the alphabet ends the phrase before it and stands for one.
        assert size[0] == len(t) and abs(count[0][0] - n) <= t.count("d") + 1
        if "d" not in t:
            assert count[0][0] == n


def test_large_alphabets_stay_apart():
    """Languages beyond any 63 characters: every character counts, and one that a language never saw ends the phrase."""
    rnd = random.Random(12)
    ranges = {"han": (0x4E00, 900), "kana": (0x3041, 80), "ru": (0x430, 32), "uk": (0x450, 16), "el": (0x3B1, 24), "en": (0x61, 26)}
    words = {k: ["".join(chr(at + rnd.randrange(n)) for _ in range(rnd.randint(1, 4))) for _ in range(400)] for k, (at, n) in ranges.items()}
    draw = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    samples = {k: draw(k, 1500) for k in ranges}
    model = language_id.LanguageModel(samples)
    tests = [(k, draw(k, 60)) for k in ranges for _ in range(10)]
    assert model.predict([t for _, t in tests])[0] == [k for k, _ in tests]
    texts = [t for _, t in tests] + [draw("ru", 20).upper() + draw("en", 20) + "Ω☃"]
    count, _ = model.phrases(texts)
    for j, lang in enumerate(model.langs):
        for i, t in enumerate(texts):
            n, match = 1, ""
            for c in t.lower():
                n, match = (n, match + c) if match + c in samples[lang] else (n + 1, c if c in samples[lang] else "")
            assert count[j][i] == n


@pytest.mark.parametrize("strip", [512, 64, 7])
def test_phrases_are_exact_across_strips(monkeypatch, strip):
    """Texts of many strips in three scripts, the samples themselves and texts of unseen characters among them."""
    monkeypatch.setattr(language_id, "STRIP", strip)
    rnd = random.Random(14)
    ranges = {"han": (0x4E00, 300), "ru": (0x430, 32), "en": (0x61, 26)}
    words = {k: ["".join(chr(at + rnd.randrange(n)) for _ in range(rnd.randint(1, 4))) for _ in range(100)] for k, (at, n) in ranges.items()}
    draw = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    samples = {k: draw(k, 400) for k in ranges}
    model = language_id.LanguageModel(samples)
    texts = [draw("ru", 20).upper() + draw("en", 20) + "Ω☃", samples["en"] * 2, samples["han"], "a", draw("en", 900), draw("ru", 100) + samples["ru"][:1000] + draw("han", 50), "Ω" * 700]
    count, size = model.phrases(texts)
    assert size.tolist() == [len(t) for t in texts]
    for j, lang in enumerate(model.langs):
        for i, t in enumerate(texts):
            n, match = 1, ""
            for c in t.lower():
                n, match = (n, match + c) if match + c in samples[lang] else (n + 1, c if c in samples[lang] else "")
            assert count[j][i] == n


def test_language_samples_are_whole_texts(spark, monkeypatch):
    """Samples hold whole texts, a language of long texts only has its shortest, and rows without an id are drawn too."""
    monkeypatch.setattr(language_id, "SAMPLE_LONGEST", 50)
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 200)
    seen = []
    monkeypatch.setattr(language_id, "LanguageModel", lambda samples: seen.append(samples))
    rows = [(None, f"{k:03d} " + "x" * 30, "aa", "s") for k in range(80)] + [(1, "y" * 300, "bb", "s"), (2, "z" * 200, "bb", "s"), (3, None, "bb", "s"), (4, " ", "cc", "s"), (5, "w" * 500, "aa", "s")]
    language_id.fit_language(spark.createDataFrame(rows, SCHEMA).repartition(3))
    (samples,) = seen
    assert set(samples) == {"aa", "bb"} and samples["bb"] == "z" * 200
    drawn = samples["aa"].split("\n")
    assert {len(t) for t in drawn} == {34} and len(set(drawn)) == len(drawn) == 6


# ------------------------------------------------------------ 10 fingerprints


def test_fingerprints(spark, odd, empty):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i * 3, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 80)))) for i in range(300)] + [(2000, None), (2001, ""), (2002, rnd.choice(vocab))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    assert len(got) == len(rows)
    bag = lambda t: collections.Counter(WORD.findall(t))
    error = [0.0, 0.0]
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for j, (other, value) in enumerate(((edited, r.near_edited), (following, r.near_next))):
            a, b = bag(t), bag(other)
            union = sum((a | b).values())
            error[j] += value - (sum((a & b).values()) / union if union else 1.0)
    assert all(abs(e / len(rows)) < 0.03 for e in error)
    one = spark.createDataFrame([(1, "same words here"), (2, "same words here"), (5, "x")], "doc_id bigint, text string")
    a, b, c = (r.fingerprint for r in fingerprints.fingerprint_documents(clashing(one)).orderBy("doc_id").collect())
    assert a == b != c
    ids = [r.doc_id for r in fingerprints.fingerprint_documents(odd).collect()]
    assert sorted(ids, key=str) == sorted({r[0] for r in odd_rows()}, key=str)
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprints_of_every_row(spark, odd, empty):
    """Rows that repeat an id, or have none, keep a row each, in the order of id and digest."""
    rnd = random.Random(14)
    some = lambda: " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30)))
    rows = [(rnd.choice([None, None, 1, 2, 3, 4]), some()) for _ in range(60)] + [(7, "same text"), (7, "same text"), (None, "same text"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    out = fingerprints.fingerprint_rows(df)
    assert out.schema["doc_id"].dataType.simpleString() == "int"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted({(i is None, i or 0, sha(t or ""), t or "") for i, t in rows})
    follows = {k[:3]: order[(n + 1) % len(order)][3] for n, k in enumerate(order)}
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        q = len(t) // 4
        want[(i, len(t), sha(t[: len(t) - q] + follows[(i is None, i or 0, sha(t))][:q]))] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out.collect()) == want
    assert fingerprints.fingerprint_rows(odd).count() == odd.count() and fingerprints.fingerprint_rows(empty).count() == 0
