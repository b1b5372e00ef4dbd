"""Classifiers: held-out accuracy, insults with inserted characters, edge cases; and the pipeline's stages."""

import zlib

import numpy as np
import pytest

from tallyframe.llm import quality, toxicity
from tallyframe.llm.queries import QUERIES

ROWS = [(1, None), (2, ""), (3, " \n"), (4, "word " * 50_000), (4, "word " * 50_000), (None, "no id")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 0.5, "p") for i, t in ROWS], "doc_id long, text string, score double, predicted string")


def held_out_labels(spark, sf_dir, kind):
    return {r.doc_id: r[kind] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


@pytest.mark.parametrize("name, kind, least", [("op5_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, kind, least):
    sf_dir = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}
    truth = held_out_labels(spark, sf_dir, kind)
    assert all(out[i].held_out for i in truth) and all(0 <= r.score <= 1 for r in out.values())
    assert np.mean([out[i].predicted == y for i, y in truth.items()]) >= least


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_edges(spark, sf_dir, edge, score):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(edge, labels).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert score(edge.limit(0), labels).count() == 0
    assert len({r.score for r in score(edge, labels.limit(0)).collect()}) == 1
    odd = spark.createDataFrame([(None, 1, 1), (4, None, None), (999_999, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(score(edge, odd).collect()) == len(ROWS)


def test_gapped_insults():
    rng = np.random.default_rng(0)
    syllables = ["an", "ther", "on", "the", "ing", "ha", "re", "sh", "ou", "er", "st", "ly"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    insults = ["stupid", "idiot", "worthless", "moron"]
    texts, y = [], []
    for i in range(500):
        toxic = i % 5 == 0
        sentences = [" ".join(word() for _ in range(8)) + "." for _ in range(4)]
        if toxic:
            sentences[rng.integers(4)] += f" {word()} {rng.choice(insults)} {word()} {rng.choice(insults)}."
        texts.append(" ".join(sentences))
        y.append(int(toxic))
    m = toxicity.fit(texts, np.array(y), 0.3)
    p = lambda t: float(m.probability(toxicity.Scorer(m)([t]))[0])
    clean = "anther onthe inghare shou erstly theon."
    for insult in ("stupid", "s.t.u.p.i.d", "st-upid", "stu*pid", "stuxpid", "s t u p i d", "STUPID", "idi_ot", "mor.on", "worth_less"):
        assert p(f"{clean} {insult} {clean}") >= 0.3, insult
    assert p(clean) < 0.3 and p("") < 0.3
    assert p("x" * 30 + "stupid" + "y" * 30) > p("x" * 30 + "theing" + "y" * 30)


def test_kernel_by_definition():
    from itertools import combinations

    def phi(w):
        w = f"\x02{w}\x03"
        out = {}
        for c in combinations(range(len(w)), 3):
            if c[2] - c[0] < toxicity.SPAN:
                k = "".join(w[i] for i in c)
                out[k] = out.get(k, 0) + toxicity.DECAY ** (c[2] - c[0] + 1)
        return out

    words = ["stupid", "stuxpid", "idiot", "a", "banana"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            fa, fb = phi(a), phi(b)
            want = sum(v * fb.get(k, 0) for k, v in fa.items()) / (toxicity.triples(len(a) + 2)[2] * toxicity.triples(len(b) + 2)[2])
            assert np.isclose(got[i, j], want)


def test_features_by_definition():
    texts = ["", "a a b, c|d!", "One two\nOne two\n%%% ###", "x " * 1000, "né wört 12"]
    data = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = quality.document_features(np.frombuffer(data, np.uint8), off)
    at = {n: i for i, n in enumerate(quality.NAMES)}
    for t, row in zip(texts, got):
        b, words, lines = t.encode(), t.split(), [x for x in t.split("\n") if x]
        assert np.isclose(row[at["pipes"]], b.count(b"|") / max(len(b), 1))
        assert np.isclose(row[at["distinct"]], len(set(words)) / max(len(words), 1))
        assert np.isclose(row[at["repeat_next"]], sum(x == y for x, y in zip(words, words[1:])) / max(len(words), 1))
        assert np.isclose(row[at["commonest"]], max([words.count(w) for w in words] or [0]) / max(len(words), 1))
        assert np.isclose(row[at["distinct_lines"]], len(set(lines)) / max(len(lines), 1))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p
    from tallyframe.llm._common import staged
    from tallyframe.llm.near_copies import shingles, similar

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        out = staged(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns
        kept[name] = (docs.collect(), out.collect())
        docs = out
    before, after = kept["near_duplicates"]
    sets = {r.doc_id: shingles((r.text or "").encode(), 5) for r in before}
    left = [r.doc_id for r in after]
    assert len(left) == len(set(left)) < len(before)
    for i in sets.keys() - set(left):  # each dropped document has a near copy, by five-word similarity
        assert any(similar(sets[i], sets[j], 80) for j in sets if j != i)
    assert not any(similar(sets[a], sets[b], 80) for a in left for b in left if a < b)
    before, after = kept["mixing"]
    known = {r.doc_id for r in before}
    assert {r.doc_id for r in after} <= known
    assert max(np.bincount([r.doc_id for r in after])) <= 3
    final = p.STAGES[-1][1](spark, docs, sf_dir)
    assert final.count() == docs.count()
    assert p.run(spark, sf_dir).count() == final.count()
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


ODD_NAMES = ["toxic_score", "text_hash", "gone_id", "row_hash", "copies", "nth", "rows", "root", "h", "size", "key", "__key", "taken"]


def odd_rows(spark, sf_dir):
    """Rows with null, empty, blank, huge, tied and repeated values, and columns with names that the stages use."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len((r.text or "").split()) > 20)
    some = [r.text for r in docs.orderBy("doc_id").limit(30).collect()]
    huge = " ".join(f"word{i * 7919 % 100_003}" for i in range(120_000))
    rows = [(i, t, "s1") for i, t in enumerate(some)]
    rows += [(100, None, "s1"), (101, "", None), (None, " \t\n", "s2"), (None, None, None), (102, huge, "s2"), (103, some[3], "s1"), (103, some[3], "s1"), (3, some[3], "s1")]
    rows += [(104, item, "s2"), (None, item, None), (105, "two words", None), (105, "other text here", "s2"), (105, "two words", None), (None, "nameless row", "s1")]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in ODD_NAMES)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(ODD_NAMES))) for i, t, s in rows], names), item


def test_stages_on_odd_rows(spark, sf_dir):
    from collections import Counter

    import corpus_pipeline as p
    from tallyframe.llm import mixing, near_copies

    docs, item = odd_rows(spark, sf_dir)
    rows = docs.collect()
    plain = lambda found: Counter((r.doc_id, r.text, r.source) for r in found)
    whole = {c: i for i, c in enumerate(ODD_NAMES)}
    outs = {name: stage(spark, docs, sf_dir) for name, stage in p.STAGES}
    for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
        assert outs[name].columns == docs.columns
        assert all(r[c] == i for r in outs[name].collect() for c, i in whole.items()), name
    # toxicity: the verdict of the trained machine on each text alone, row by row
    from tallyframe.llm._common import table

    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), threshold=p.TOXIC)
    bad = lambda t: machine.probability(toxicity.Scorer(machine)([t or ""]))[0] >= p.TOXIC
    assert plain(outs["toxicity"].collect()) == Counter({k: n for k, n in plain(rows).items() if not bad(k[1])})
    # near-duplicates: brute force over all pairs of texts
    texts = sorted({r.text or "" for r in rows})
    sets = [near_copies.shingles(t.encode(), 5) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if near_copies.similar(sets[a], sets[b], 80):
                group = [group[b] if g == group[a] else g for g in group]
    named = dict(zip(texts, group, strict=True))
    left = plain(outs["near_duplicates"].collect())
    assert Counter(named[t or ""] for _, t, _ in left.elements()) == Counter(set(group)) and not left - plain(rows)
    for (i, t, _), _ in left.items():
        ids = [r.doc_id for r in rows if named[r.text or ""] == named[t or ""] and r.doc_id is not None]
        assert i == (min(ids) if ids else None)
    # decontamination: rows that hold a whole benchmark text go, others without a 13-word window stay
    stay = plain(outs["decontamination"].collect())
    assert not any(t == item for _, t, _ in stay)
    assert stay == Counter({k: n for k, n in plain(rows).items() if k in stay}) and {k for k in plain(rows) if len((k[1] or "").split()) < 5} <= stay.keys()
    # mixing: by what the mix takes of each (doc_id, source, text)
    mixed = plain(outs["mixing"].collect())
    taken = mixing.mix_digest(docs)
    assert set(mixed) <= set(plain(rows)) and not any(not (t or "").split() for _, t, _ in mixed)
    assert all(n <= 3 * plain(rows)[k] for k, n in mixed.items()) and taken.count() == len(rows)
    assert mixed == plain(p.mixing(spark, docs.repartition(3), sf_dir).collect())
    # token output: every row, null ids last
    final = outs["token_output"].orderBy("start").collect()
    assert Counter(r.doc_id for r in final) == Counter(r.doc_id for r in rows) and final[-1].doc_id is None
    assert all(b.start == a.start + a.n_tokens for a, b in zip(final, final[1:]))
