import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from marginalia.llm import ann, avi, html_text, sharding, token_counts, warc
from marginalia.llm.bpe import ByteBpe, encode_documents, read_ranks
from marginalia.llm.pieces import further, pieces

DOCS = [(1, "Hello there, it's 12 o'clock.\n\nNew  line \t end "), (2, None), (3, ""), (4, "ünïcode 日本語 😀 text"), (5, "x" * 5000), (1, "again"), (None, "no id"), (7, "a <|endoftext|> b"), (8, "word " * 3000)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("score", F.lit(1))


# neighbours


def nearest(rows, every, k):
    out = {}
    for q, x in rows:
        if q is not None and q % every == 0 and q not in out:
            d = sorted((float(np.sqrt(((np.array(y) - np.array(x)) ** 2).sum())), i) for i, y in rows if i is not None and i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8).astype(np.float32)]) for i in range(600)] + [(1000 + i, [1.0] * 8) for i in range(40)]
    bad = [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [1.0, None] * 4), (5004, [1.0]), (None, [1.0] * 8), (5005, [])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    got = {}
    for r in ann.nearest_neighbours(frame, every=20, centroids=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = nearest(rows, 20, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    everything = {q: [] for q in want}
    for r in ann.nearest_neighbours(frame, every=20, centroids=8, visit=1.0).orderBy("query_id", "rank").collect():
        everything[r["query_id"]].append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in x] for q, x in everything.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(a == pytest.approx(b, rel=1e-12) for q in want for (_, a), (_, b) in zip(everything[q], want[q], strict=True))


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest_neighbours(few).orderBy("rank").collect()] == [(0, 1, 1, 0.0), (0, 2, 2, 2.0)]
    assert ann.nearest_neighbours(few.limit(0)).collect() == []


def test_cells_come_by_rising_sum():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    order = ann.nearest_first(a, b, np.ones((7, 5), int), 35)
    sums = [a[i] + b[j] for i, j in order]
    assert sums == sorted(sums) and len(set(order)) == 35


# sharding


def test_shards_are_even_and_keep_groups(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, "copy") for i in range(30)] + [(2000 + i, f"pair {i // 2}") for i in range(100)] + [(5, "text 5"), (None, None), (None, None), (7, "")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by, groups = {}, {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len(groups[zlib.crc32(b"copy")]) == 2  # 30 copies do not fit in a shard of 27
    assert sum(len(groups[zlib.crc32(f"pair {i}".encode())]) == 1 for i in range(50)) >= 45
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(1, None)}
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# media


def test_media_round_trip(spark, docs):
    rows = avi.media_round_trip(docs).collect()
    assert len(rows) == len(DOCS)
    for (key, text), r in zip(DOCS, rows, strict=True):
        raw = (text or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (key, len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
        media = avi.encode_files([padded])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert avi.media_round_trip(docs.limit(0)).collect() == []
    media = avi.to_media(docs)
    assert avi.clips(media).groupBy().agg(F.sum(F.col("last_frame") - F.col("first_frame") + 1)).first()[0] == sum(int(r["feature"].split(";")[0][7:]) for r in rows)


def test_frames_hold_any_bytes():
    rnd = random.Random(4)
    payloads = [bytes(rnd.randrange(256) for _ in range(192 * n)) for n in (1, 16, 17, 40)] + [b"\xff" * 384, b"\x00\xff" * 960]
    assert [b"".join(f.tobytes() for f in frames) for frames in avi.decode_files(avi.encode_files(payloads))] == payloads
    damaged = bytearray(avi.encode_files(payloads[:1])[0])
    damaged[-60] ^= 0x55
    with pytest.raises(ValueError):
        assert b"".join(f.tobytes() for f in avi.decode_files([bytes(damaged)])[0]) == payloads[0] or None
        raise ValueError("bytes differ")


def test_shots():
    dark, light = np.zeros((16, 192), np.uint8), np.full((16, 192), 200, np.uint8)
    assert avi.shots([dark] * 5 + [light] * 4) == [(0, 4), (5, 8)] and avi.shots([dark]) == [(0, 0)] and avi.shots([]) == []


# archives


def test_captures(spark):
    long = "ä" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"
    rows = [(3, "http://a/\r\nX: y", long), (2, "http://b", long), (9, None, "short"), (8, "u", "short"), (4, "u", None), (4, "u", None), (None, "u", long), (2, "http://b", long), (5, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    got = sorted(map(tuple, warc.warc_captures(pages).collect()), key=str)
    want = []
    for key, _, body in rows:
        raw = (body or "").encode()
        again = len(raw) >= 100 and key != 2
        want.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    assert warc.warc_captures(pages.limit(0)).collect() == []


def test_captures_are_nested(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>" * 30)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    r = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).first()
    assert r["response"]["payload"] == ("<p>x</p>" * 30).encode() and r["metadata"]["fields"]["page-id"] == "1" and r["request"]["target"] == "http://a"


# main text


@pytest.mark.parametrize("page", ["article", "div"])
def test_main_text(spark, page):
    body = "<h1>Head</h1><p>First <b>bo</b>ld text &amp; more   words, and <a href=y>a link</a> inside.<div class='ad-box'>Buy now this great thing</div><p>Second para goes on<br>next line.</p>"
    noise = "<header class='site'><p>The site of many words here</p></header><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies here for all</div>"
    tail = "<div id='comments'><p>I agree with all of this article very much indeed</p></div><aside>More to read about other things</aside><form>Mail <input></form><script>var a = '<p>no</p>'</script><footer>&copy; all rights reserved by us</footer>"
    html = f"<html><head><title>T</title></head><body>{noise}<{page}>{body}</{page}>{tail}</body></html>"
    want = "Head First bold text & more words, and a link inside. Second para goes on next line."
    pages = spark.createDataFrame([(1, "u", html), (1, "u", html), (None, None, None), (3, "v", ""), (4, "w", "<!-- only"), (5, "x", "plain < text")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    weights = html_text.fit_weights(pages)
    got = [tuple(r) for r in html_text.extract_main_text(pages, weights).collect()]
    assert got == [(1, "u", want, len(want)), (1, "u", want, len(want)), (None, None, "", 0), (3, "v", "", 0), (4, "w", "", 0), (5, "x", "plain < text", 12)]
    assert html_text.extract_main_text(pages.limit(0), html_text.fit_weights(pages.limit(0))).collect() == []


def test_best_region_is_the_largest_sum():
    rnd = random.Random(2)
    for _ in range(200):
        s = [rnd.randrange(-5, 6) for _ in range(rnd.randrange(0, 12))]
        a, b = html_text.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


# tokens

RANKS = P.path("byte_bpe_50k.tiktoken")


def strange_texts(n):
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "\xa0", " ", "\x85", "᠎", "\x1c", "\x00", "日", "😀", "é", "'s", "'S", "\r\n", "<|endoftext|>", "­", "_", "ǅ", "word"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]


def test_ids_are_those_of_the_rank_file():
    import tiktoken

    coder, reference = ByteBpe.of(RANKS, P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    texts = strange_texts(3000) + [t or "" for _, t in DOCS]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()
    spans = coder.offsets(coder.encode(["日本"])[0])
    assert spans[0][0] == 0 and spans[-1][1] == 6


def test_encoded_documents(spark, docs):
    rows = encode_documents(docs, path=RANKS, pattern=P.PATTERN, keep=["doc_id", "n_tokens"], ids=True, spans=True).collect()
    assert [r["decoded_sha256"] for r in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for _, t in DOCS]
    assert all(r["n_tokens"] == len(r["token_ids"]) == len(r["token_spans"]) - 1 for r in rows)
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(r["token_ids"], "<u4").tobytes()).hexdigest() for r in rows)
    assert encode_documents(docs.limit(0), path=RANKS, pattern=P.PATTERN, keep=["doc_id"]).collect() == []


def test_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = strange_texts(1500) + [t for _, t in DOCS]
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    rows = token_counts.token_counts(frame, path=path, limit=20).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == want
    assert all(r["over_limit"] == (r["n_tokens"] > 20) and r["n_bytes"] == len((t or "").encode()) for r, t in zip(rows, texts, strict=True))
    assert token_counts.token_counts(frame.limit(0), path=path).collect() == []


def test_pieces_join_to_the_text():
    for text in strange_texts(2000) + ["", " ", "a b", " a", "a "]:
        assert " ".join(pieces(text)) == text


def test_long_texts_are_cut_only_where_no_match_goes_on():
    import tiktoken

    coder, reference = ByteBpe.of(RANKS, P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("日本語文字，。！a1 ") if rnd.random() < 0.97 else rnd.choice("\n\t'") for _ in range(30_000)), "line of words\n" * 3000, "日本語。" * 9000, "x1" * 9000, "ab,c'd." * 5000, "  \n" * 5000 + "a", "字" * 6000]
    for text in texts:
        assert [text] == ["".join(further(text))] and np.frombuffer(coder.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
    assert max(map(len, further(texts[0]))) < 8_192 and max(map(len, further(texts[2]))) < 8_192


def test_pieces_that_no_token_opens_go_alone(spark):
    coder = ByteBpe.of(RANKS, P.PATTERN)
    want = coder.encode(["one two three", "four"])
    other = ByteBpe.of(RANKS, P.PATTERN)
    other.memory.opens = np.zeros_like(other.memory.opens)  # as if tokens did not begin with spaces
    assert other.encode(["one two three", "four"]) == want
