from collections import Counter, defaultdict

from oracle import assert_same, connection

from tidepool.llm import linedup, quality, queries, secrets

SF = "/root/testdata/sf0.001"


def _words(t):
    return (t or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")


def _base(t):
    t = t or ""
    w = [x for x in _words(t) if x]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if any(_words(x))]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)





def test_base_on_odd_texts(docs):
    texts = [None, "", " \n\t", "a b c a b c", "x y z x y z x y z", "a a a a", "one two", "é 🙂 # $\n\nx\nx\n x", "\x1cword\x1d two", "w " * 5000, "\u00a0non breaking"]
    rows = {r.doc_id: r for r in quality.judge(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def _own(i, n):
    """Words that no other number has, without digits."""
    return " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j % 26) * (1 + j // 26) for j in range(n))


def test_frequent_lines_deplete(docs):
    body = "\n".join(f"unique {i} " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(1))
    shared = " ".join(f"menu{j}" for j in range(100))
    rows = [(i, f"{shared} 1{i}\n" + _own(i, 70), "h") for i in range(40)]
    rows += [(100 + i, _own(50 + i, 120), "h") for i in range(40)]
    rows += [(200, f"{shared} 77\n" + body, "other"), (201, f"{shared} 9\n" + body, None)]
    got = {r.doc_id: r for r in quality.judge(docs(rows)).collect()}
    digits = [r for i, r in got.items() if i < 40]
    # Numbers in lines don't count: "menu99 10" and "menu99 139" differ in their number of digits only.
    assert sum(not r.kept for r in digits) >= 30 and all(r.kept for i, r in got.items() if 100 <= i < 200)
    assert got[200].kept and got[201].kept and not got[200].words_removed


def test_copies_count_once(docs):
    text = " ".join(f"w{j}" for j in range(80))
    got = quality.judge(docs([(i, text) for i in range(100)])).collect()
    assert all(r.kept for r in got) and len(got) == 100


def test_filter_takes_effect(docs):
    line = "all of this is a menu line"
    rows = [(i, line + "\n" + _own(i, 70)) for i in range(50)] + [(60, "short")]
    out = quality.filter_documents(docs(rows)).collect()
    assert len(out) == 50 and all(line not in r.text and r.n_chars == len(r.text) for r in out)


def test_sql(spark):
    con = connection(SF)
    for name in ("op2_quality", "op7_lines", "op3_urls", "op5_minhash", "op10_vectors"):
        assert_same(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


def test_lines_against_plain_python(docs):
    rows = [(i, f"boiler\n own {i}\n\nboiler\n text", "a" if i % 2 else "b") for i in range(40)] + [(90, None, "a"), (91, "", None), (92, "boiler", "c")]
    pages, lines = Counter(), defaultdict(set)
    for d, t, h in rows:
        pages[h] += 1
        for x in (t or "").split("\n"):
            if x.strip(" "):
                lines[h, x.strip(" ")].add(d)
    gone = {k for k, v in lines.items() if len(v) >= linedup.MIN_PAGES and len(v) > pages[k[0]] * linedup.MAX_RATIO}
    got = {r.doc_id: r for r in linedup.drop_boilerplate(docs(rows)).collect()}
    assert gone
    for d, t, h in rows:
        kept = None if t is None else [x for x in t.split("\n") if (h, x.strip(" ")) not in gone]
        assert got[d].text == (None if t is None else "\n".join(kept))
        assert got[d].n_dropped == (0 if t is None else len(t.split("\n")) - len(kept))


def test_empty_and_extra_columns(spark, docs):
    from pyspark.sql import functions as F

    assert quality.judge(docs([])).collect() == [] and linedup.drop_boilerplate(docs([])).collect() == []
    names = ("host", "line", "lines", "key_a", "n", "n_lines", "total", "_host", "_lines", "_q", "_s", "_doc", "_text", "_left", "_gone", "base", "spans", "_more", "n_words")
    extra = docs([(1, "a b " * 40)]).withColumns({c: F.lit(c) for c in names})
    assert quality.judge(extra, max_docs=0).count() == 1
    extra = docs([(1, "a b")]).withColumns({c: F.lit(c) for c in names})
    row = linedup.drop_boilerplate(extra, min_pages=1, max_ratio=0.5).first()
    assert (row.n_lines, row.n_dropped, row.text, row._left, row._gone) == (1, 1, "", "_left", "_gone")
    ratios = secrets.train(secrets.labelled_samples(spark))
    assert secrets.redact(extra, ratios).first()._more == "_more" and secrets.find_secrets(extra, ratios).first()._text == "_text"
    words = " ".join(chr(97 + i % 26) * (1 + i // 26) for i in range(60))
    row = quality.filter_documents(docs([(1, words)]).withColumns({c: F.lit(c) for c in names})).first()
    assert (row.text, row._q, row.n) == (words, "_q", "n")
