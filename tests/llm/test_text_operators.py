"""op2, op5 to op10 against plain versions, round trips, held-out figures and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import corpus, frame, shingles, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from umbrafold.llm import chat, decontaminate, edit_embedding, hmm, ordinal, packing, site_style_tree

PIECES = ["\\", "### ", "</turn>", "a", "b", "\n", " ", "###", "</", "turn>", "é", "user"]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_turns_are_found_and_read_back():
    r = random.Random(1)
    for _ in range(3000):
        turns = [("".join(r.choices(PIECES, k=r.randint(0, 4))), "".join(r.choices(PIECES, k=r.randint(0, 6)))) for _ in range(r.randint(0, 4))]
        formatted, spans, rewrites = chat.locate_turns(turns, chat.marked_turns)
        assert not rewrites and chat.read_turns(formatted) == turns
        assert [chat.unescape(formatted[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
        assert "".join(formatted[a:b] for a, b, _, _ in spans) == formatted


def test_rewriting_templates_are_detected():
    last_marked = lambda turns: "".join(f"{r}:{t};" for r, t in turns[:-1]) + "".join(f"*{r}:{t};" for r, t in turns[-1:])
    only_two = lambda turns: "|".join(t for _, t in turns[-2:])
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    assert chat.locate_turns(turns, last_marked)[2] and chat.locate_turns(turns, only_two)[2]
    formatted, spans, rewrites = chat.locate_turns(turns, last_marked)
    assert [formatted[c:d] for _, _, c, d in spans] == ["one", "two", "three"]
    formatted, spans, _ = chat.locate_turns(turns, only_two)
    assert [formatted[c:d] for _, _, c, d in spans] == ["", "two", "three"]


def test_long_conversations_are_located_fast():
    r = random.Random(2)
    turns = [(("user", "assistant")[k % 2], "".join(r.choices("ab \\#", k=200))) for k in range(800)]
    began = time.time()
    formatted, spans, rewrites = chat.locate_turns(turns, chat.marked_turns)
    assert time.time() - began < 3 and not rewrites
    assert [chat.unescape(formatted[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    for x, y in (("", ""), ("abc", "abd"), ("abc", "abc"), ("a" * 5000 + "x", "a" * 5000 + "y"), ("b", "a")):
        plain = next((k for k, (i, j) in enumerate(zip(x, y, strict=False)) if i != j), min(len(x), len(y)))
        assert all(chat._common(x, y, hint) == plain for hint in (0, 1, 100))


def test_format_conversations(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", "first"), (1, None, None, None), (2, 0, "assistant", None), (None, 0, "user", "x"), (-7, 0, "user", said), (-7, 1, "assistant", said), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame([(*x, 5, "z") for x in rows], "conv_id long, turn long, role string, text string, turns int, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("\n\nuser\nfirst\nassistant\nsecond\n") and got[1]["n_turns"] == 3
    assert (got[-7]["loss_chars"], got[-7]["loss_sha256"]) == (len(said), sha(said))
    assert got[3]["loss_sha256"] == sha("samesame") and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_fingerprints(spark):
    rows = [r for r in corpus(20) if r[0] not in (5009, 5010, None)]
    got = {r["doc_id"]: r for r in edit_embedding.fingerprints(frame(spark, rows), buckets=7).collect()}
    docs = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(docs)
    prints = {}
    for k, (i, text) in enumerate(docs):
        edited = edit_embedding.edited(text, docs[(k + 1) % len(docs)][1])
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    long = [got[i] for i, t in docs if len(t) > 300 and i < 5000]
    assert np.mean([r["near_edited"] - r["near_next"] for r in long]) > 0.4 and all(r["near_edited"] > 0.4 for r in long)
    odd = spark.createDataFrame([(None, "abc"), (None, None), (1, "x"), (1, "x")], "doc_id long, text string")
    assert edit_embedding.fingerprints(odd).count() == 4 and edit_embedding.fingerprints(odd.limit(0)).count() == 0


def test_walk_equals_a_plain_loop():
    """Character by character, one text at a time, whatever the lengths of the texts beside it."""
    r = random.Random(13)
    texts = ["".join(r.choices("abcdé 语", k=n)) for n in (0, 1, 2, 63, 64, 130, 700, 3000, 9000)]
    for text, got in zip(texts, edit_embedding.walk([edit_embedding.codes(t) for t in texts]), strict=True):
        c, at, step, written = edit_embedding.codes(text), 0, 0, {}
        while at < len(c):
            written[step] = int(edit_embedding.DIGITS[c[at]])
            at += int(edit_embedding.MOVES[step % edit_embedding.PERIOD, c[at]])
            step += 1
        octaves = range(6, max(step - 1, 1).bit_length() if step > 64 else 7) if len(c) else range(0)
        kept = list(octaves)[-edit_embedding.OCTAVES :]
        assert sorted(got) == kept
        for k in kept:
            assert got[k].tolist() == [written.get(s, 0) for s in edit_embedding.sampled_steps(k).tolist()]


def test_likeness_falls_with_edits():
    r, text = random.Random(2), " ".join(words(4, 700))
    scores = []
    for n in (0, 3, 30, 300):
        other = list(text)
        for _ in range(n):
            at = r.randrange(len(other))
            other[at : at + r.randint(0, 1)] = r.choice("xyz")
        a, b = edit_embedding.walk([edit_embedding.codes(text), edit_embedding.codes("".join(other))])
        scores.append(edit_embedding.likeness(edit_embedding.fingerprint(len(text), a), edit_embedding.fingerprint(len(other), b)))
    assert scores[0] == 1 and min(scores[1:3]) > 0.7 and scores[3] < min(scores[1:3])  # one draw of the walk, so no finer order


def test_near_pairs_by_bands(spark):
    text = " ".join(words(4, 300))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, text), (4, " ".join(words(5, 300)))], "doc_id long, text string")
    pairs = {(r["doc_id"], r["near_id"]) for r in edit_embedding.near_pairs(edit_embedding.fingerprints(df)).collect()}
    assert pairs == {(2, 1), (3, 1)}


def test_likenesses_equal_likeness():
    r = random.Random(6)
    base = " ".join(words(8, 400))
    texts = [base[: r.randint(1, len(base))] + "".join(r.choices("abc ", k=r.randint(0, 90))) for _ in range(12)] + ["a", "b", base + base[:700]]
    prints = edit_embedding._prints_of(texts)
    for upto, start in ((len(texts), 0), (5, 5)):
        for i, j, found in edit_embedding.likenesses(prints, upto, start):
            assert j == max(i + 1, start)
            assert np.allclose(found, [edit_embedding.likeness(prints[i], p) for p in prints[j:]])


def test_classes_of_near_texts(spark, monkeypatch):
    """Classes against all pairs compared by brute force, with a band's documents in several blocks; pairs that miss the first document of a band count."""
    r, rows = random.Random(9), []
    for family in range(12):
        base = "".join(words(100 + family, 120)[k % 120] + " " for k in range(160 + 40 * family))
        for k in range(8):
            text = list(base)
            for _ in range(len(base) * k // 600):
                text[r.randrange(len(text))] = r.choice("xyzw")
            rows += [(1000 * k + family, "".join(text))] * (1 + (family == 3 and k == 2))
    rows += [(9000, rows[0][1]), (9001, None), (9002, ""), (None, rows[0][1]), (9003, "a"), (9004, "a")]
    df = spark.createDataFrame([(*x, 4, "k") for x in rows], "doc_id long, text string, class_id int, fingerprint string")
    monkeypatch.setattr(edit_embedding, "BLOCK", 2)
    prints = edit_embedding.own_fingerprints(df)
    own = {(x["doc_id"], x["fingerprint"]) for x in prints.collect()}
    assert len(own) == len({x for x in rows if x[0] is not None}) and all(p == q for i, p in own for j, q in own if dict(rows)[i] == dict(rows)[j])
    full = sorted(x for x in own if "|" in x[1])
    near = {(i, j) for k, (j, p) in enumerate(full) for i, q in full[k + 1 :] if edit_embedding.likeness(p, q) >= 0.75}
    pairs = {(x["doc_id"], x["near_id"]): x["likeness"] for x in edit_embedding.near_pairs(prints).collect()}
    assert set(pairs) <= near and all(s == pytest.approx(edit_embedding.likeness(dict(own)[i], dict(own)[j])) for (i, j), s in pairs.items())
    cls = {x["doc_id"]: x["class_id"] for x in edit_embedding.near_classes(prints).collect()}
    together = sum(cls.get(i, i) == cls.get(j, j) for i, j in near)
    assert len(near) > 100 and together >= 0.98 * len(near)
    got = edit_embedding.fingerprints(df, buckets=3, classes=edit_embedding.near_classes(prints)).collect()
    assert len(got) == len(rows) and all(x["class_id"] == (None if x["doc_id"] is None else cls.get(x["doc_id"], x["doc_id"])) for x in got)
    assert cls[9000] == 0 and cls[9004] == 9003 and 9001 not in cls
    assert edit_embedding.near_classes(edit_embedding.own_fingerprints(df.limit(0))).count() == 0


@pytest.mark.parametrize("blocks", [(0, 0), (0, 1)])
def test_a_group_gives_fewer_pairs_than_rows(blocks):
    """A family whose members are all near each other and in classes of their own, in one block or two."""
    base = list(" ".join(words(8, 400)))
    prints = edit_embedding._prints_of(["".join([*base[: 9 * k], "#", *base[9 * k + 1 :]]) for k in range(60)] + [" ".join(words(9, 400))])
    block = [blocks[k >= 30] for k in range(61)]
    names = ["band", "lo", "hi", "doc_id", "class", "block", "fingerprint"]
    batch = pa.record_batch([pa.array(x) for x in ([7] * 61, [blocks[0]] * 61, [blocks[1]] * 61, range(61), range(61), block, prints)], names)
    pairs = [(i, j) for out in edit_embedding._across(0.75)([batch]) for i, j in zip(*(out.column(c).to_pylist() for c in ("doc_id", "near_id")), strict=True)]
    near = {(j, i) for i in range(61) for j in range(i) if blocks[0] == blocks[1] or block[i] != block[j] if edit_embedding.likeness(prints[i], prints[j]) >= 0.75}
    top = list(range(61))
    for i, j in pairs:
        top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
    assert len(near) > 500 and len(pairs) < 61 and {(j, i) for i, j in pairs} <= near
    assert all(top[i] == top[j] for i, j in near)


def test_packing(spark):
    rows = corpus(30) + [(7000 + k, "same length here") for k in range(50)]
    got = packing.pack_documents(frame(spark, rows), TOKENIZER, size=64).collect()
    tokenizer, expected = Tokenizer.from_file(TOKENIZER), Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            expected[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) <= 64
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 64) * 1.02 + 1
    assert packing.pack_documents(frame(spark, []), TOKENIZER).count() == 0


def test_words_are_tokenized_as_in_whole_texts():
    table, tokenizer = packing.WordIds(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    table.limit = 50
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choices(["a", "B", "é", "É", "É", " ", "\n", ".", ",", "'s", "'S", "1", "23", "\t", "<|endoftext|>", "ß", "İ", "Σ", "语", "x", " "], k=r.randint(0, 14)))
        assert np.frombuffer(table.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_gives_each_rank_one_slot():
    r = random.Random(6)
    for _ in range(60):
        size = r.randint(1, 40)
        histogram = {k: r.randint(1, 9) for k in r.sample(range(1, size + 1), r.randint(1, size))}
        room, taken = Counter(), Counter()
        for length, a, b, first, per, at in packing.best_fit(histogram, size):
            for rank in range(a, b):
                sequence, offset = first + (rank - a) // per, at + (rank - a) % per * length
                taken[length, rank] += 1
                room[sequence] += length
                assert offset + length <= size
        assert set(taken.values()) == {1} and sum(taken.values()) == sum(histogram.values()) and max(room.values()) <= size


def test_containment_search(spark, monkeypatch):
    items = [(k, " ".join(words(10_000 + k, n))) for k, n in enumerate((3, 4, 5, 6, 7, 9, 12, 17, 30, 64, 65, 90, 200))] + [(90, None), (91, ""), (None, "no id but words enough"), (0, "again under its id with other words")]
    r, docs = random.Random(8), list(corpus(10))
    for k in range(60):
        item = items[k % 13][1].split()
        cut = item[: max(1, int(len(item) * r.uniform(0.6, 1)))]
        docs.append((8000 + k, " ".join(words(k, r.choice((0, 40, 900, 5000))) + cut + words(k + 1, 30))))
    expected = set()
    for i, text in items:
        q = shingles(text)
        expected |= {(d, i) for d, t in docs if q and i is not None and d is not None and len(q & shingles(t)) >= 0.75 * len(q)}
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(frame(spark, docs), table).collect()]
    assert set(got) == expected and len(got) == len(expected) > 10
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 500)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(frame(spark, docs), table).collect()} == expected
    kept = decontaminate.clean_documents(frame(spark, docs), table)
    assert kept.count() == sum(i not in {d for d, _ in expected} for i, _ in docs)
    assert decontaminate.contained_items(frame(spark, []), table).count() == 0 == decontaminate.contained_items(frame(spark, docs), table.limit(0)).count()


def test_signatures_are_small_and_find_what_is_there():
    r = random.Random(12)
    items = [(k, " ".join(words(20_000 + k, (6, 12, 40, 100, 300, 900)[k % 6]))) for k in range(300)]
    index = decontaminate.ItemIndex([(i, t.encode()) for i, t in items])
    found, there = Counter(), Counter()
    for i, text in items:
        own = text.split()
        keep = len(own) - int(r.uniform(0, 0.22) * (len(own) - 4))
        doc = " ".join([*words(i, r.choice((50, 2000))), *own[:keep], *words(i + 1, 50)])
        q, d = shingles(text), shingles(doc)
        if len(q & d) >= 0.75 * len(q):
            there[decontaminate.size_class(len(q))] += 1
            found[decontaminate.size_class(len(q))] += i in index.ids[index.candidates(decontaminate.shingle_hashes(decontaminate.WordHashes().array(doc.encode().split())))]
    assert len(there) >= 6 and all(found[c] >= 0.99 * n for c, n in there.items())  # recall in each size class
    large = [t for _, t in items if len(t.split()) >= 300]
    minima = decontaminate.ItemIndex([(k, t.encode()) for k, t in enumerate(large)])
    assert len(minima.keys) == decontaminate.SIGNATURE * len(large) < 0.11 * len(minima.shingles)
    own = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))
    assert own < 32 * sum(len(t.split()) for _, t in items) + (1 << 17)
    for n in (1, 5, 32, 33, 1000):  # the chance of falling short, by simulation of the worst case
        assert decontaminate.least_common(n) <= 0.75 * min(n, decontaminate.SIGNATURE) + 1


def test_forward_and_expected_counts_equal_all_paths():
    r = np.random.default_rng(3)
    model = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.2, 0.3], [0.3, 0.6]]))
    sequences = [r.integers(0, 3, n) for n in (1, 4, 7, 7, 11)]
    lanes = hmm.Lanes(sequences)
    start, moves, emissions, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for k, seq in enumerate(sequences):
        paths = [np.array([p >> t & 1 for t in range(len(seq))]) for p in range(1 << len(seq))]
        chance = [model.start[p[0]] * np.prod(model.move[p[:-1], p[1:]]) * np.prod(model.emit[seq, p]) for p in paths]
        assert math.isclose(lanes.likelihoods(model)[k], math.log10(sum(chance)))
        total += math.log10(sum(chance))
        for p, c in zip(paths, chance, strict=True):
            w = c / sum(chance)
            start[p[0]] += w
            np.add.at(moves, (p[:-1], p[1:]), w)
            np.add.at(emissions, (seq, p), w)
    got = lanes.expected(model)
    for x, y in zip(got[:3], (start, moves, emissions), strict=True):
        assert np.allclose(x, y)
    assert math.isclose(got[3], total)


def test_language_model(spark, sf, monkeypatch):
    monkeypatch.setattr(hmm, "RESOLVED", 2000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9000, None), (9001, ""), (None, "null id"), (9002, "zz " * 5000)], "doc_id long, text string"))
    rows = hmm.language_model_scores(docs.withColumn("h", F.lit(1))).collect()
    tokens = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), b"\n"]) for r in docs.collect()]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(t for i, ts in tokens if not out(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    expected = {i: (out(i), len(ts), sum(counts[t] > 0 for t in ts), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for i, ts in tokens}
    assert len(rows) == len(tokens)
    for r in rows:
        held, size, known, base = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, size, known, n) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    new = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)
    assert hmm.language_model_scores(docs.limit(0)).count() == 0


def test_chances_of_all_next_words_add_up_to_one(spark):
    docs = spark.createDataFrame([(k, " ".join(words(k % 3, 30))) for k in range(30)], "doc_id long, text string")
    counts, table = hmm.count_words(docs.select("text"))
    model, likelihoods = hmm.train(docs.select("text"), counts)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(likelihoods, likelihoods[1:], strict=False))
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)
    own, total = set(counts.own.values()), 0.0
    size = Counter()
    for r in table.collect():
        c = counts.own.get(r["h"], hmm.OWN_CLASSES + r["h"] % hmm.ENDINGS)
        size[c] += 1 if c in own else (r["n"] + 1) / 10 ** counts.room[c]
    for c in range(hmm.OWN_CLASSES, hmm.CLASSES):
        total = size[c] + 1 / 10 ** counts.room[c]  # the words never seen together count as one
        assert math.isclose(total, 1)


def test_severity_is_ordered_and_holds_out(spark):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        text, grade = words(k, 60), (0, 0, 0, 1, 2)[k % 5]
        for _ in range((0, 2, 8)[grade]):
            text.insert(r.randrange(len(text)), r.choice(["Villain", "villainous,", "scoundrel", "rotter."]))
        rows.append((k, " ".join(text)))
        labels.append((k, grade))
    docs = frame(spark, [*rows, (None, "villain"), (9001, None), (9002, ""), (0, rows[0][1])])
    graded = spark.createDataFrame([*labels[:400], (None, 1), (3, None)], "doc_id long, grade int")
    model = ordinal.train_severity(docs, graded)
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal.score_severity(docs, model).collect()
    assert len(got) == 604
    held = [(x, labels[x["doc_id"]][1]) for x in got if x["doc_id"] is not None and 400 <= x["doc_id"] < 600]
    assert np.mean([x["toxic"] == (g > 0) for x, g in held]) > 0.97 and np.mean([x["severity"] == g for x, g in held]) > 0.9
    assert np.corrcoef([x["expected_severity"] for x, _ in held], [g for _, g in held])[0, 1] > 0.9
    kept = ordinal.keep_harmless(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not x["toxic"] for x in got)
    labels = graded.select("doc_id", (F.col("grade") > 0).cast("int").alias("toxic"))
    assert len(ordinal.train_from_labels(docs, labels, often=3).thresholds) == 2 and len(ordinal.train_from_labels(docs, labels, often=10**9).thresholds) == 1
    clean = ordinal.train_severity(docs, graded.where("grade = 0"))
    assert ordinal.keep_harmless(docs, clean).count() == 604
    assert ordinal.score_severity(docs.limit(0), model).count() == 0


def test_ordinal_fit_finds_shared_weights():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 2))
    score = x @ np.array([2.0, -1.0]) + r.logistic(size=4000)
    grade = np.digitize(score, [-1.0, 1.5])
    w, cuts = ordinal.fit_ordinal(x, grade, np.ones(4000), 3)
    assert np.allclose(w, [2, -1], atol=0.2) and np.allclose(cuts, [-1, 1.5], atol=0.2)


def test_site_style_tree(spark):
    page = lambda k, body: f"<html><head><title>t{k}</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><div>Menu of all pages</div>{body}<div class='cookie-notice'>We use</div><footer>&copy; x</footer></body></html>"
    rows = [(k, f"https://a.example/{k}", page(k, f"<div><h1>Title {k}</h1><p>Words of page {k}<p>more &amp; more {k * 3}<br>end</div>")) for k in range(20)]
    rows += [(50, "https://b.example/", page(0, "<article><header><h1>Alone</h1></header><p>A <b>bold\n  word</p><aside>no</aside><ul><li>x<li>y</ul><div class='comments'>no</div><script>var a='<p>no</p>'</script><!-- no --></article>"))]
    rows += [(60, None, None), (61, "u", ""), (62, "u", "just text <b>open"), (None, "https://a.example/n", rows[0][2]), (0, rows[0][1], rows[0][2]), (63, "u", "<" * 3000 + "a " * 3000), (64, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    for at_once in (4_000_000, -1):
        got = site_style_tree.main_texts(df, at_once=at_once).collect()
        assert len(got) == len(rows)
        text = {r["page_id"]: r["text"] for r in got}
        assert all(text[k] == f"Title {k}\nWords of page {k}\nmore & more {k * 3} end" for k in range(20))
        assert text[50] == "Alone\nA bold word\nx\ny"
        assert (text[60], text[61], text[62], text[64]) == ("", "", "just text open", "deep")
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert site_style_tree.main_texts(df.limit(0)).count() == 0


def test_importance_decides_inside_and_outside_an_article(spark):
    page = lambda k: f"<body><div class='intro'>Opening {k} of its own</div><div class='top'>Same top</div><article><h1>Title {k}</h1><p>Words of page {k}</p><div class='about'>We sell shoes since 1999</div></article></body>"
    rows = [(k, f"https://c.example/{k}", page(k)) for k in range(12)] + [(90, "https://d.example/", page(90))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for at_once in (4_000_000, -1):
        text = {r["page_id"]: r["text"] for r in site_style_tree.main_texts(df, at_once=at_once).collect()}
        assert all(text[k] == f"Opening {k} of its own\nTitle {k}\nWords of page {k}" for k in range(12))
        assert text[90] == "Title 90\nWords of page 90\nWe sell shoes since 1999"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<body><h1 class='post-title'>T</h1><div class='content'><p>body of the page</p></div></body>", "T\nbody of the page"),
        ("<body><div class='entry-meta'>May</div><div class='content'><p>body of the page</p></div></body>", "May\nbody of the page"),
        ("<body><div class='post-header'><h1>T</h1></div><div class='content'><p>body of the page</p></div></body>", "T\nbody of the page"),
        ("<body><form id='aspnet'><nav>Home</nav><h1>T</h1><p>body of the page</p></form></body>", "T\nbody of the page"),
        ("<body><article><h1>T</h1><div class='share-price table'>Shares rose by two</div><div class='search-engine-history'>It began with a crawler</div><div class='comment-list'>me too</div></article></body>", "T\nShares rose by two\nIt began with a crawler"),
        ("<body><div id='topNav'>Home</div><div class='site-footer'>All rights</div><div class='newsletter_signup'>Join</div><div class='header-top'>Hello</div><p>body of the page</p></body>", "body of the page"),
        ("<body><p>body of the page</p><form><p>Your name</p></form></body>", "body of the page"),
        ("<body><div>All pages</div><div class='post'><h1>T</h1><p>body of the page</p></div></body>", "T\nbody of the page"),
    ],
)
def test_names_of_parts_do_not_hide_the_body(spark, source, text):
    df = spark.createDataFrame([(1, "https://a.example/", source)], "page_id long, url string, html string")
    assert [r["text"] for r in site_style_tree.main_texts(df).collect()] == [text]


def test_the_tree_decides_on_the_table(spark, sf):
    """Every block that names leave open is weighed by its host's tree, and the texts are those of a plain reading of these pages."""
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sold = "<div class='about-us'>We sell shoes since 1999</div>"
    more = pages.withColumn("html", F.concat(F.regexp_replace("html", "</article>", f"{sold}</article>")))
    got = {r["page_id"]: r["text"] for r in site_style_tree.main_texts(more).collect()}
    parsed = site_style_tree.staged(more.withColumn("key", F.col("page_id")).mapInArrow(site_style_tree._parse, site_style_tree.PARSED), "parsed")
    sizes = {r["host"]: r["n"] for r in parsed.groupBy("host").agg(F.countDistinct("page").alias("n")).collect()}
    decided = parsed.select("host", F.explode("blocks").alias("b")).where("b.open").groupBy("host").count().collect()
    assert sum(r["count"] for r in decided if sizes[r["host"]] > 1) > 0.5 * sum(r["count"] for r in decided)
    dropped = 0
    for r in pages.collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|h3|ul|li|div)[^>]*>", re.sub("<br>", " ", body))
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in blocks]
        plain = "\n".join(x for x in plain if x)
        dropped += got[r["page_id"]] == plain
        assert got[r["page_id"]] in (plain, f"{plain}\nWe sell shoes since 1999")
    assert dropped > 0.5 * len(got)  # hosts with several pages: the tree finds what they share, whatever its name


@pytest.mark.parametrize("source", ["<p", "<a <b>", "&#xZZ; &amp", "<script>never closed", "<!-- open", "</div></p>x", "<table><tr><td>a<td>b<tr><td>c</table>d", "<![CDATA[x]]>"])
def test_broken_pages_do_not_crash(source):
    site_style_tree.kept_text(source, 0, np.zeros(0, np.int64))


def test_sketches_bound_likeness_and_only_rows_that_may_be_near_go_on():
    """The bound holds for all pairs of lengths; few documents that share a band by chance go on, near ones all do, also over batches' ends."""
    r, texts = random.Random(3), []
    base = "".join(r.choices("etaoin shrdlu,.", k=5000))
    for n in (1, 2, 44, 63, 64, 70, 100, 128, 200, 256, 500, 1000, 4000):
        for edits in (0, 0, n // 100, n // 30, n // 10):
            text = list(base[: max(1, n + r.randint(-n // 8, n // 8))])
            for _ in range(edits):
                text[r.randrange(len(text))] = r.choice("xyz")
            texts.append("".join(text))
        texts.append("".join(r.choices("etaoin shr", k=n)))
    prints = edit_embedding._prints_of(texts)
    marks = edit_embedding.marked(pa.array(range(len(prints)), pa.int64()), prints)
    sketch = edit_embedding._sketch(marks)
    i, j = (x.ravel() for x in np.meshgrid(range(len(prints)), range(len(prints))))
    bound = edit_embedding.at_most(tuple(c[i] for c in sketch), tuple(c[j] for c in sketch))
    true = np.array([edit_embedding.likeness(prints[a], prints[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    assert (np.maximum(bound, 0) >= true - 1e-9).all() and (true >= 0.75).sum() > 200
    assert edit_embedding.marked(pa.array([5]), ["0"]).column("bands").to_pylist() == [[]]

    n, texts = 90, ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=3900)) for _ in range(89)]
    prints = edit_embedding._prints_of([*texts, texts[-1][:-1] + "#"])
    sketch = edit_embedding._sketch(edit_embedding.marked(pa.array(range(n), pa.int64()), prints))
    for lo, hi, block in ((0, 0, [0] * n), (0, 1, [k % 2 for k in range(n)])):
        columns = [[7] * n, [lo] * n, [hi] * n, list(range(n)), list(range(n)), block]
        names = [c.split()[0] for c in edit_embedding.MEETING.split(", ")]
        batch = pa.record_batch([*map(pa.array, columns), *map(pa.array, sketch)], [*names, "reach", "last", "before"])
        for at_once in (7, 1 << 19):
            found = edit_embedding._hopeful(0.75, at_once)([batch.slice(0, 89), batch.slice(89)])
            kept = [x for out in found for x in out.column("doc_id").to_pylist()]
            assert kept[-2:] == [n - 2, n - 1] and len(kept) < 10
