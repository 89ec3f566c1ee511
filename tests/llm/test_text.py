"""Toxic passages, transcripts and the pipeline."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from tabsmith.llm import toxicity, transcripts


def brute_segments(scores):
    """All maximal segments by the definition: take the best one, split there, go on."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[2], -best[2] - best[1]
    return brute_segments(scores[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments_against_the_definition():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 25)
        hits = sorted(rng.sample(range(n), rng.randint(0, n)))
        found = [(p, rng.choice([1.5, 2.25, 3.125])) for p in hits]
        scores = [-0.75] * n
        for p, s in found:
            scores[p] = s
        assert toxicity.segments(found, 0.75) == brute_segments(scores)


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(4)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    bad = ["vile", "nasty", "rotten", "awful"]
    rows, labels = [], []
    for i in range(1200):
        body = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(bad))
        rows.append((i, " ".join(body).capitalize() + "."))
        labels.append((i, 1, int(toxic)))
    labels += [(0, 1, 1), (None, 1, 1), (5, 1, None)]
    return rows, labels


def test_held_out_accuracy(spark, texts, marked):
    rows, labels = marked
    docs = texts([*rows, (9001, None), (9002, ""), (None, "vile nasty rotten"), (9003, "worda " * 50_000 + "vile vile vile")])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table.filter(~toxicity.held_out()))
    assert set(model.scores) == {"^vile^", "^nasty^", "^rotten^", "^awful^"}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = {i: t for i, _, t in labels if i is not None and t is not None}
    test = [i for i in truth if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i]["score"] >= 0.5) == bool(truth[i]) for i in test)
    assert len(test) > 150 and right / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[9001]["score"] == got[9002]["score"] < 0.5 and got[None]["score"] > 0.5 and len(got[9003]["passages"]) == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] < 0.5}


def plain_tokens(word):
    marked = f"^{word}^"
    return {marked} | {marked[i : i + n] for n in range(4, 9) for i in range(len(marked) - n + 1)}


def plain_model(rows):
    """The fitted model from (text, toxic) pairs, one text and one word at a time."""
    split = [(re.findall(r"[^\W\d_]+", t.lower()), y) for t, y in rows]
    n = [sum(not y for _, y in split), sum(y for _, y in split)]

    def evidence(sums):
        (c_, cs, cv), (t, ts, tv) = sums
        common = (ts + cs) / sum(n)
        score = math.log(((ts + common) / (n[1] + 1)) / ((cs + common) / (n[0] + 1)))
        return t, score, (ts, tv, cs, cv)

    rough = {}
    for words, y in split:
        for w in set(words):
            rate = 10**6 // max(len(set(words)), 20)
            for g in plain_tokens(w):
                row = rough.setdefault(g, ([0, 0, 0], [0, 0, 0]))[y]
                row[0], row[1], row[2] = row[0] + 1, row[1] + rate, row[2] + rate * rate
    known = {}
    for g, sums in rough.items():
        t, score, (ts, tv, cs, cv) = evidence(sums)
        z = (ts / n[1] - cs / n[0]) / math.sqrt(tv / n[1] ** 2 + cv / n[0] ** 2)
        if t >= 4 and z >= 4 and score >= 1:
            known[g] = 0.0
    best = lambda w: min(plain_tokens(w) & set(known), key=lambda g: (-known[g], -len(g), g), default=None)
    for alone in (False, True, True):
        table = {}
        for words, y in split:
            mine = {}
            for w in set(words):
                for g in ({best(w)} - {None} if alone else plain_tokens(w) & set(known)):
                    mine[g] = mine.get(g, 0) + 1
            for g, k in mine.items():
                rate = min(k * 10**6 // max(len(set(words)), 20), 50_000)
                row = table.setdefault(g, ([0, 0, 0], [0, 0, 0]))[y]
                row[0], row[1], row[2] = row[0] + 1, row[1] + rate, row[2] + rate * rate
        known = {}
        for g, sums in table.items():
            t, score, (ts, tv, cs, cv) = evidence(sums)
            spread = (tv / n[1] - (ts / n[1]) ** 2) / n[1] + (cv / n[0] - (cs / n[0]) ** 2) / n[0]
            if t >= 4 and score >= 1 and (ts / n[1] - cs / n[0]) / math.sqrt(max(spread, 1.0)) >= 4:
                known[g] = min(score, 8.0)
    hits = lambda words: [(i, known[best(w)]) for i, w in enumerate(words) if w not in words[:i] and best(w)]
    total = sum(len(w) for w, y in split if not y)
    chance = {g: 0.5 for g in known}
    for g in known:
        seen = sum(best(w) == g for words, y in split if not y for w in set(words))
        chance[g] = max(seen, 0.5) / (total + 1)
    return known, hits, chance, total, split


def test_training_and_score_against_plain_python(spark, texts):
    """Stems with ever other endings, whole words, repeated words and a clean text that holds a stem once."""
    rng = random.Random(9)
    syllables = ["ba", "co", "di", "fu", "le", "mo", "ni", "ra", "si", "tu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    rows = []
    for i in range(400):
        body = [word() for _ in range(rng.randint(3, 60))]
        toxic = i % 5 == 0
        if toxic:
            extra = ["grumpf"] if i % 2 else ["zorkach" + word() for _ in range(3)]
            for w in extra:
                body.insert(rng.randrange(len(body)), w)
        elif i % 50 == 1:
            body += ["zorkach" + word()] + ["same"] * 30
        rows.append((i, " ".join(body).title(), int(toxic)))
    docs = texts([(i, t) for i, t, _ in rows])
    table = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    pairs = {}
    for _, t, y in rows:
        pairs[t] = max(y, pairs.get(t, 0))
    known, hits, chance, total, split = plain_model(list(pairs.items()))
    assert model.scores.keys() == known.keys() and any("zorkach"[:6] in g for g in known)
    assert all(math.isclose(model.scores[g], known[g], rel_tol=1e-12) for g in known)
    law = sum(p * math.exp(model.lam * known[g]) for g, p in chance.items()) + (1 - sum(chance.values())) * math.exp(-model.lam * 0.02)
    assert math.isclose(law, 1, abs_tol=1e-9) and math.isclose(model.k, sum(chance.values()) + 1 / (total + 1))

    def evidence(words):
        scores = [-0.02] * len(words)
        for i, x in hits(words):
            scores[i] = x
        out = 0.0
        for _, _, x in brute_segments(scores):
            expected = model.k * max(len(words), 1) * math.exp(-model.lam * x)
            out -= math.log(expected) if expected <= 0.1 else 0.0
        return out

    x = [(round(min(evidence(words), 60.0), 1), y) for words, y in split]
    p = lambda e: 1 / (1 + math.exp(-(model.slope * e + model.offset)))
    # At the fitted curve the slopes of the shrunk likelihood are zero.
    assert abs(sum((y - p(e)) * e for e, y in x) - 0.1 * model.slope) < 1e-4
    assert abs(sum(y - p(e) for e, y in x) - 1e-3 * model.offset) < 1e-4
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, t, _ in rows:
        words = re.findall(r"[^\W\d_]+", t.lower())
        assert math.isclose(got[i], p(evidence(words)), rel_tol=1e-9), i


def test_training_without_a_class(spark, texts, marked):
    rows, _ = marked
    none = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    model = toxicity.train(texts(rows), none)
    assert model.scores == {} and all(r["score"] < 0.5 for r in toxicity.score(texts(rows[:20]), model).collect())
    empty = toxicity.train(texts([]), none.limit(0))
    assert toxicity.score(texts([]), empty).count() == 0 and not math.isnan(empty.offset)


# --- transcripts ------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, n int"


@pytest.fixture(scope="module")
def chat(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(150):
        if conv % 5 == 0:
            rows.append((conv, 0, "system", "You are a helpful guide. Keep to the facts.", 1))
        for turn in range(1, rng.randint(2, 9)):
            role = "user" if turn % 2 else "assistant"
            text = "What about this?" if role == "user" else "An answer of some length. " * rng.randint(2, 9) + "\nMore on that.\n\nAnd an end."
            rows.append((conv, turn, role, text, 1))
    rows += [(500, None, None, None, 1), (None, 1, "user", "Who?", 1), (501, 1, "user", "Twice?", 1), (501, 1, "user", "Twice?", 1), (502, 1, "assistant", "line\n" * 7000, 1)]
    return spark.createDataFrame(rows, CHAT), rows


def brute_viterbi(model, seen):
    states = range(transcripts.STATES)
    if len(seen) <= 4:
        paths = itertools.product(states, repeat=len(seen))
    else:
        raise ValueError("too long")

    def score(path):
        s = model.start[path[0]] + model.emit[path[0], seen[0]]
        for a, b, x in zip(path, path[1:], seen[1:]):
            s += model.move[a, b] + model.emit[b, x]
        return s

    return max(score(p) for p in paths), score


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    n = transcripts.STATES
    model = transcripts.RoleModel(rng.random(n), rng.random((n, n)), rng.random((n, transcripts.SYMBOLS)))
    for _ in range(12):
        seen = rng.integers(0, transcripts.SYMBOLS, 4)
        best, score = brute_viterbi(model, seen)
        assert math.isclose(score(model.decode(seen, None, None)), best)
        matrix = model.matrix(seen[:2], True).max(0)
        rest = model.matrix(seen[2:], False)
        assert math.isclose((matrix[:, None] + rest).max(), best)


def test_chunks_give_the_same_roles_as_whole_transcripts(chat):
    lines = transcripts.materialise(transcripts.symbols(transcripts.transcripts(chat[0])), "t")
    model = transcripts.train(lines.filter(transcripts.training_fold()))
    bare = lines.select("conv", "n", "line", "symbol")
    found = {ch: {(r["conv"], r["n"]): r["found"] for r in transcripts.find_roles(bare, model, chunk=ch).collect()} for ch in (1 << 20, 5)}
    assert found[5] == found[1 << 20] and len(found[5]) == lines.count()
    for conv in {r["conv"] for r in lines.filter("n < 3").select("conv").distinct().limit(5).collect()}:
        seen = [r["symbol"] for r in lines.filter(lines.conv == conv).orderBy("n").collect()]
        assert [found[5][conv, i] for i in range(len(seen))] == model.decode(np.array(seen), None, None)


def test_most_roles_are_found(chat):
    lines = transcripts.symbols(transcripts.transcripts(chat[0]))
    model = transcripts.train(lines.filter(transcripts.training_fold()))
    found = {(r["conv"], r["n"]): r["found"] for r in transcripts.find_roles(lines, model).collect()}
    truth = {(r["conv"], r["n"]): r["state"] for r in lines.filter("conv != '502'").collect()}
    assert sum(found[k] // 2 == v // 2 for k, v in truth.items()) / len(truth) > 0.9


def test_turns_are_rendered(chat):
    df, rows = chat
    turns = transcripts.format_conversations(df).collect()
    per = {}
    for r in turns:
        assert r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>"
        per.setdefault(r["conv"], []).append((r["turn"], r["n_lines"]))
    assert all(sorted(t for t, _ in x) == list(range(len(x))) for x in per.values())
    lines = sum(len((r[3] or "").split("\n")) for r in rows)
    assert sum(n for x in per.values() for _, n in x) == lines
    assert set(per) == {"" if r[0] is None else str(r[0]) for r in rows}
    assert transcripts.format_conversations(df.limit(0)).count() == 0


# --- the pipeline ---------------------------------------------------------------------------

def test_stages_chain_and_keep_the_columns(spark):
    public = pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    import sentencepiece

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, before = docs.columns, docs.count()
    for label, stage in corpus_pipeline.STAGES[:-1]:
        docs = transcripts.materialise(stage(spark, docs, folder), label)
        assert docs.columns == names and docs.count() > 0.5 * before, label
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public.path("piece_bpe_32k.model")))
    want = sorted((r["doc_id"], len(sp.encode(r["text"] or ""))) for r in docs.collect())
    out = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out.collect()) == want
