"""The pipeline's stages against plain Python on a small corpus with planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from test_native import one_after_another  # noqa: E402
from test_text import brute_segments, plain_model  # noqa: E402

from tabsmith.llm import toxicity, transcripts  # noqa: E402

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic texts, shared lines, templates, exact and near copies, null ids and texts."""
    rng = random.Random(21)
    syllables = ["ba", "co", "di", "fu", "le", "mo", "ni", "ra", "si", "tu", "ve", "po"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    texts, toxic = [], {}
    for i in range(260):
        body = [word() for _ in range(rng.randint(12, 50))]
        if i % 6 == 0:
            toxic[i] = 1
            for _ in range(4):
                body.insert(rng.randrange(len(body)), "zorkach" + word())
        lines = [" ".join(body[j : j + 12]) for j in range(0, len(body), 12)]
        if i % 9 == 1:
            lines.insert(1, "all rights are kept by the owner of this page")
        if i % 9 == 2:
            lines.append(f"the server {i} sent {i * 3} rows to client number {i}")
        texts.append("\n".join(lines))
    copies = [texts[i] for i in (5, 5, 7, 13, 13, 13)]
    near = [" ".join(texts[i].split(" ")[:-1]) for i in (25, 31, 37, 43)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(300 + i, t, "en", "s1", len(t)) for i, t in enumerate(copies + near)]
    rows += [(400, None, None, None, None), (401, "", "en", None, 0), (None, " ".join(word() for _ in range(30)), "en", "s2", 1), (402, "two words", "en", "s3", 9)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, KINDS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, toxic.get(i, 0)) for i in range(260)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels, toxic


def plain_toxicity(rows, labels, model):
    """The fitted numbers are tested elsewhere; the evidence of every text is worked out here."""
    marks = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 5}
    pairs = {}
    for i, t, *_ in rows:
        if i in marks:
            pairs[t or ""] = max(marks[i], pairs.get(t or "", 0))
    known, hits, *_ = plain_model(list(pairs.items()))
    assert known.keys() == model.scores.keys()
    out = []
    for row in rows:
        words = re.findall(r"[^\W\d_]+", (row[1] or "").lower())
        scores = [-0.02] * len(words)
        for i, x in hits(words):
            scores[i] = x
        found = [math.log(model.k * max(len(words), 1)) - model.lam * x for _, _, x in brute_segments(scores)]
        if model.slope * -sum(e for e in found if e <= math.log(0.1)) + model.offset < 0:
            out.append(row)
    return out


def plain_lines(rows):
    seen, leaves = {}, {}
    for row in rows:
        for line in (row[1] or "").split("\n"):
            masked = re.sub("[0-9]+", "0", line.strip(" "))
            if masked:
                leaf = masked.count(" ") + 1, " ".join(masked.split(" ")[:3])
                seen[line] = leaf, masked
                leaves.setdefault(leaf, {}).setdefault(masked, set()).add(row[1])
    of, texts, longest = {}, {}, {}
    for leaf, lines in leaves.items():
        for masked, seed in one_after_another({x: len(t) for x, t in lines.items()}).items():
            of[leaf, masked] = seed
            texts.setdefault((leaf, seed), set()).update(lines[masked])
            longest[leaf, seed] = max(longest.get((leaf, seed), 0), len(masked))
    least = {}
    for i, t, *_ in rows:
        least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    gone = {}
    for (leaf, seed), held in texts.items():
        if len(held) >= (2 if leaf[0] >= 5 or longest[leaf, seed] >= 40 else 10):
            gone[leaf, seed] = held - {min(held, key=lambda t: least[t])}
    out = []
    for i, t, lang, source, n in rows:
        if t is not None:
            drops = lambda line: line in seen and t in gone.get((seen[line][0], of[seen[line]]), ())  # noqa: E731, B023
            t = "\n".join(line for line in t.split("\n") if not drops(line))
        out.append((i, t, lang, source, None if t is None else len(t)))
    return out


def plain_near(rows):
    sets = {}
    for _, t, *_ in rows:
        w = re.findall(WORD, (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[t or ""] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    keys = [t for t in sets if sets[t]]
    root = {t: t for t in keys}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if 100 * len(x & y) >= 75 * len(x | y):
                root[top(keys[a])] = top(keys[b])
    order = lambda row: (row[0] is None, row[0] or 0, hashlib.md5((row[1] or "").encode()).hexdigest())
    best = {}
    for row in sorted((r for r in rows if sets[r[1] or ""]), key=order):
        best.setdefault(top(row[1]), row)
    return [*best.values(), *[r for r in rows if not sets[r[1] or ""]]]


def plain_mix(rows):
    size = {id(r): len(re.findall(WORD, r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    whole = {s: sum(size[id(r)] for r in rows if r[3] == s) for s in sources}
    target, left = {}, 1.5 * sum(whole.values())
    free = list(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2.0 * whole[s]]
        for s in full or free:
            target[s] = 2.0 * whole[s] if full else level * weight[s]
        left -= sum(2.0 * whole[s] for s in full)
        free = [s for s in free if s not in target]
    out = []
    for s in sources:
        before = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()):
            middle = before + size[id(r)] / 2
            out += [r] * sum(size[id(r)] > 0 and middle + k * whole[s] < target[s] for k in range(2))
            before += size[id(r)]
    return out


def test_every_stage_against_plain_python(spark, corpus):
    folder, rows, labels, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    table = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, table.filter(~toxicity.held_out()))
    plain = {
        "toxicity": lambda r: plain_toxicity(r, labels, model), "line_dedup": plain_lines, "ngram_join": plain_near, "mixing": plain_mix,
    }
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = transcripts.materialise(stage(spark, docs, folder), name)
        rows = plain[name](rows)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert Counter(tuple(r) for r in docs.collect()) == Counter(rows), name
        counts.append(len(rows))
    # Toxic documents and copies are caught, clean ones stay.
    assert not {r[0] for r in rows} & set(toxic) and 200 < counts[0] <= 260 + 14 - len(toxic) and counts[2] <= counts[1] - 6
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(r[0], sp.encode(r[1] or "")) for r in rows]
    want = Counter((i, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, x in ids)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == want
