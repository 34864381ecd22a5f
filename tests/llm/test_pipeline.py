"""The pipeline's stages on one table, each against plain Python where it changes rows."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm import linedup, quality, queries, secrets
from tidepool.llm.store import written


WORD = re.compile("[^\x20\x09-\x0d]+")


def _quality(docs):
    """``doc_id: text`` of what the rules keep, without lines that are frequent in their source."""
    texts, having = defaultdict(set), defaultdict(set)

    def norm(line):
        return re.sub("[1-9]", "0", " ".join(WORD.findall(line)).lower())

    for r in docs:
        for line in (r.text or "").split("\n"):
            if WORD.search(line):
                texts[r.source].add(r.text)
                having[r.source, norm(line)].add(r.text)
    frequent = {k for k, v in having.items() if len(v) > quality.MAX_DOCS and len(v) > quality.MAX_SHARE * len(texts[k[0]])}
    out = {}
    for r in docs:
        words = WORD.findall(r.text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(i, i + 3)}
        left = [x for x in (r.text or "").split("\n") if not WORD.search(x) or (r.source, norm(x)) not in frequent]
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and len(WORD.findall("\n".join(left))) >= quality.MIN_LEFT * len(words):
            out[r.doc_id] = "\n".join(left)
    return out


def _lines(docs):
    """``doc_id: text`` without lines that too many of their source's documents have."""
    pages, having = Counter(r.source for r in docs), defaultdict(set)
    for i, r in enumerate(docs):
        for line in (r.text or "").split("\n"):
            if WORD.search(line):
                having[r.source, line.strip(" ")].add(i)
    gone = {k for k, v in having.items() if len(v) >= linedup.MIN_PAGES and len(v) > linedup.MAX_RATIO * pages[k[0]]}
    return {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if (r.source, x.strip(" ")) not in gone) for r in docs}


def _redacted(found):
    out = {}
    for r in found:
        text, at = "", 0
        for s in r.spans:
            if s.start >= at:
                text += r.text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        out[r.doc_id] = text + r.text[at:]
    return out


def test_quality_and_line_stages_remove_what_plain_python_does(spark, docs):
    """A source whose lines are frequent enough for both stages."""
    import random

    rng = random.Random(5)

    def own(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    rows = [(i, "\n".join([f"Menu {i} of this site", own(40), " shared footer ", own(30)] if i % 2 else [own(60), "shared footer", "\t", own(rng.choice([5, 70]))]), "abc"[i % 3]) for i in range(120)]
    rows = [(i, t + "\nsmall note" * (i % 4 == 0), s) for i, t, s in rows]
    rows += [(200 + i, "\n".join(["all pages have this line " * 20 + str(i), own(20)]), "a") for i in range(25)] + [(300, None, "a"), (301, "", "b")]
    table = docs(rows)
    first = written(corpus_pipeline.quality_rules(spark, table, ""), "test")
    expected = _quality(table.collect())
    assert {r.doc_id: r.text for r in first.collect()} == expected and 0 < len(expected) < len(rows) - 25
    second = corpus_pipeline.line_dedup(spark, first, "")
    assert {r.doc_id: r.text for r in second.collect()} == _lines(first.collect())
    assert _lines(first.collect()) != expected != {i: t for i, t, _ in rows if i in expected}


def test_stages(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, results = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test")
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])
    passed, lines, near, redacted, packed = ({r.doc_id: r for r in x.collect()} for x in results)
    verdict = queries.op2_quality(spark, sf)
    assert set(passed) == {r.doc_id for r in verdict.where("kept").collect()}
    assert {d: r.text for d, r in passed.items()} == _quality(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert {d: r.text for d, r in lines.items()} == _lines(list(passed.values()))

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(r.text) for d, r in lines.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(near) == {d for d in sets if find(d) == d}
    found = secrets.find_secrets(results[2], secrets.train(secrets.labelled_samples(spark)))
    assert {d: r.text for d, r in redacted.items()} == _redacted(found.collect())
    left = secrets.find_secrets(results[3], secrets.train(secrets.labelled_samples(spark))).select(F.sum(F.size("base"))).first()[0]
    assert left == 0
    library = Tokenizer.from_file(tokenizer)
    total = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in redacted.values())
    assert results[4].agg(F.sum("length")).first()[0] == total and set(packed) == set(redacted)


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    spots = np.array([(r.sequence_id, r.offset, r.length) for r in rows])
    assert len({tuple(s[:2]) for s in spots}) == len(rows)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
