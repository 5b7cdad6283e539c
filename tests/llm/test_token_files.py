"""op12 and op13 against encodings of whole texts, plain checksums and a plain alignment."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from fixtures import corpus, frame
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from umbrafold.llm import alignment, queries, record_files, token_ids

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "　", "᠎", "\x1c", "\xa0", "a", "b.", ",", "s", "'s", "'", "1", "²", "é", "é", "foo", "Bar.", "<|endoftext|>", "<s>", "!", "😀", "½", "中文", "▁"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(BYTE_LEVEL)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def odd_texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, 9))) for _ in range(n)]


def test_ids_by_words_are_those_of_the_whole_text(whole):
    own = token_ids.ByteLevelIds(BYTE_LEVEL)
    known = own.token_bytes()
    for text in odd_texts(20_000):
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == whole(text) and b"".join(known[i] for i in ids) == text.encode()


def test_marks_behind_letters_are_encoded_once(whole):
    """Letters' merges alone and the marks' kept ids, in place of the whole encoder for each such word; apostrophes, digits and marks before letters go the long way."""
    own, calls, r = token_ids.ByteLevelIds(BYTE_LEVEL), [], random.Random(5)
    ids = own.ids
    own.tails.find = own.ids = lambda text: (calls.append(text), ids(text))[1]
    tails = [*"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "***", "$$$", ".,", "!?"]
    text = "a" + "".join(f" {r.choice(['ouvi', 'teberß', 'é', 'Q'])}{k * 'x'}{t}" for k in range(20) for t in tails)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == whole(text) and len(calls) <= 1 + len(tails)
    for word in ("it's", "it'", "a'.", "a.'s", "a1.", "a.b.", "!a", "a²!", "中.", "\na.", "a.᠎", "<|endoftext|>", "a\u0301."):
        for text in (f"x {word}", f"x {word} s", f"{word} {word}"):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == whole(text)


def plain_crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums_and_frames():
    r = random.Random(1)
    parts = [b"123456789", *(r.randbytes(r.choice([4, 5, 8, 63, 64, 65, 127, 128, 129, 1000, 5000])) for _ in range(40))]
    got = record_files.crc32c(parts).tolist()
    assert got[0] == 0xE3069283 and got == [plain_crc32c(p) for p in parts]
    records = record_files.framed(parts)
    assert record_files.unframed(records) == parts and record_files.unframed(record_files.framed([])) == []
    for at in (3, 9, 14, len(records[5]) - 1):
        bad = bytearray(records[5])
        bad[at] ^= 4
        with pytest.raises(record_files.CorruptRecord):
            record_files.unframed([records[0], bytes(bad)])


def expected_records(rows: list[tuple], whole) -> Counter:
    """(doc_id, start, n_tokens, crc32) in ascending order; equal ids may stand in any order."""
    out, start = Counter(), 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*whole(text or ""), 0], "<u4")
        out[(i, start, len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    return out


def test_the_query_gives_the_whole_table_back(spark, whole):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op12_record_files(spark, SF).collect())) == expected_records(rows, whole)


def test_odd_documents_in_small_shards_and_in_drawn_order(spark, whole, tmp_path):
    unique = {i: t for i, t in corpus() if i is not None} | dict(enumerate(odd_texts(60), 9000))
    docs = frame(spark, list(unique.items()))
    index = record_files.write_records(docs, f"file://{tmp_path}", BYTE_LEVEL, shard_bytes=3000)
    want = expected_records(list(unique.items()), whole)
    assert Counter(map(tuple, record_files.read_records(index, f"file://{tmp_path}", at_once=2000).collect())) == want
    assert index.select("file").distinct().count() > index.select("part").distinct().count()
    drawn = record_files.shuffled(index, 7, 3)
    again = [r["doc_id"] for r in drawn.collect()]
    assert again == [r["doc_id"] for r in record_files.shuffled(index, 7, 3).collect()] != sorted(again)
    read = record_files.read_records(drawn, f"file://{tmp_path}", with_ids=True).collect()
    assert Counter(tuple(r)[:4] for r in read) == want
    assert all(r["ids"] == [*whole(unique[r["doc_id"]] or ""), 0] for r in read)
    some = index.where("doc_id % 7 = 3")
    assert {r["doc_id"] for r in record_files.read_records(some, f"file://{tmp_path}").collect()} == {i for i in unique if i % 7 == 3}
    damaged = next(tmp_path.glob("*.rec"))
    damaged.write_bytes(damaged.read_bytes()[:-1] + b"?")
    with pytest.raises(PythonException, match="checksum"):
        record_files.read_records(index, f"file://{tmp_path}").count()


def test_null_and_repeated_ids_and_an_empty_table(spark, whole):
    rows = [(None, "nobody's"), (None, None), (7, "same"), (7, "same"), (7, "same"), (3, "x y")]
    got = Counter(tuple(r) for r in record_files.record_round_trip(frame(spark, rows), BYTE_LEVEL).collect())
    assert sum(got.values()) == 6 and Counter((i, n) for i, _, n, _ in got.elements()) == Counter((i, len(whole(t or "")) + 1) for i, t in rows)
    at = sorted((start, n, i) for i, start, n, _ in got.elements())
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(at, at[1:], strict=False)) and [i for _, _, i in at] == [None, None, 3, 7, 7, 7]
    assert record_files.record_round_trip(frame(spark, []), BYTE_LEVEL).count() == 0


def plain_alignment(rows: list[tuple], whole) -> list[tuple]:
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = token_ids.ByteLevelIds(BYTE_LEVEL).token_bytes()
    b_name = {i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())}
    kept, counts = [], Counter()
    for i, text in rows:
        a, b = (whole(f" {text}"), model.encode(text)) if text else ([], [])
        if any(b"".join(map(n.__getitem__, ids)) != f" {text}".encode() for n, ids in ((names, a), (b_name, b))):
            a, b = [], []
        spans = []
        for ids, n in ((a, names), (b, b_name)):
            ends = np.cumsum([len(n[x]) for x in ids]).tolist() if ids else []
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)) if ids else [])
        links, at = [], 0
        for s, e, x in spans[0]:
            while at < len(spans[1]) and spans[1][at][1] <= s:
                at += 1
            k = at
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        text_of, done = [], [0, 0]
        for cut in common:
            sides = []
            for j, side in enumerate(spans):
                begin = done[j]
                while done[j] < len(side) and side[done[j]][1] <= cut:
                    done[j] += 1
                sides.append(",".join(str(x) for _, _, x in side[begin : done[j]]))
            text_of.append("|".join(sides))
        kept.append((i, len(a), len(b), len(common), links, hashlib.sha256(";".join(text_of).encode()).hexdigest() if a else ""))
        counts.update(links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, na, nb, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha) for i, na, nb, g, x, sha in kept]


def test_the_alignment_query_equals_a_plain_one(spark, whole):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op13_token_alignment(spark, SF).collect())) == Counter(plain_alignment(rows, whole))


@pytest.mark.parametrize("frequent", [1 << 18, 200])
def test_odd_texts_are_aligned(spark, whole, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = [*corpus(20), *enumerate(odd_texts(3000, 4), 9000)]
    got = alignment.link_report(alignment.aligned(alignment.tokenized(frame(spark, rows), BYTE_LEVEL, PIECES)))
    assert Counter(map(tuple, got.collect())) == Counter(plain_alignment(rows, whole))
    assert alignment.link_report(alignment.aligned(alignment.tokenized(frame(spark, []), BYTE_LEVEL, PIECES))).count() == 0


def test_links_and_groups_of_given_tokens(spark):
    rows = [(1, [5, 6, 7], [1, 4, 6], [8, 9, 10], [2, 4, 6]), (2, [], [], [], [])]
    got = {r["doc_id"]: r for r in alignment.aligned(spark.createDataFrame(rows, alignment.TOKENS)).collect()}
    assert list(zip(got[1]["link_a"], got[1]["link_b"], strict=True)) == [(5, 8), (6, 8), (6, 9), (7, 10)]
    assert (got[1]["groups"], got[1]["n_groups"], got[2]["groups"], got[2]["link_a"]) == ("5,6|8,9;7|10", 2, "", [])


def test_new_words_of_a_batch_are_tokenized_together_and_its_texts_aligned_at_once(spark):
    """As the whole texts' ids; one call of the piece model for all new words of a batch."""
    both, plain, calls = alignment.BothIds(BYTE_LEVEL, PIECES), alignment.BothIds(BYTE_LEVEL, PIECES), []
    texts = [t or "" for _, t in corpus(20)] + odd_texts(1500, 11)
    want = []
    for t in texts:
        a, b = (np.frombuffer(x, "<u4") for x in plain.encode(t))
        want.append([*a.tolist(), *(b | alignment.OF_B).tolist()])
    got = [np.frombuffer(x, "<u4") for x in both.encode_all(texts)]
    assert [[*x[x < alignment.OF_B].tolist(), *x[x >= alignment.OF_B].tolist()] for x in got] == want
    docs = frame(spark, list(enumerate(texts)))
    assert alignment.aligned_texts(docs, BYTE_LEVEL, PIECES).exceptAll(alignment.aligned(alignment.tokenized(docs, BYTE_LEVEL, PIECES))).isEmpty()

    encode = both.pieces.encode
    both.pieces = type("Counting", (), {"encode": staticmethod(lambda x, **how: (calls.append(len(x)), encode(x, **how))[1])})
    both.encode_all([f"the newword{k} of" for k in range(50)])
    assert len(calls) == 1 and calls[0] >= 50
