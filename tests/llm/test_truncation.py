import random
import re

import numpy as np


from kmerloom.llm import truncation as T

WORDS = "anchor bridge carton damper engine folder gasket harbor index journal kettle lantern marker notch orchard pebble quarry ribbon saddle timber".split()


def python_file(rng, n):
    lines = []
    for _ in range(n):
        a, b, c = (rng.choice(WORDS) for _ in range(3))
        lines += [f"def load_{a}({b}, {c}):", f"    {a} = {b} + {c}", f"    return store_{c}({a}, {rng.randrange(99)})", ""]
    return "\n".join(lines)


def c_file(rng, n):
    out = []
    for _ in range(n):
        a, b = rng.choice(WORDS), rng.choice(WORDS)
        out.append(f"static int get{a.title()}(int {b})\n{{\n\tint {a} = {b} * 2;\n\treturn {a};\n}}\n")
    return "\n".join(out)


def corpus(rng):
    docs, cut = [], set()
    for i in range(400):
        text = (python_file if i % 2 else c_file)(rng, rng.randrange(8, 14))
        source = ("paste", "Mirror ", " mirror", None)[i % 4]
        if source == "paste" and len(text) > 600 and i % 3 == 0:
            text = text[:600]
            cut.add(i)
        elif i % 23 == 0:
            at = text.rindex("return") - rng.randrange(1, 4)  # in the line before, within its last word
            text = text[:at].rstrip()[:-1]
            cut.add(i)
        elif i % 7 == 0:
            text = text.rstrip("\n")  # complete without a final newline
        docs.append((i, text, source))
    return docs, cut


def test_corpus(spark):
    docs, cut = corpus(random.Random(1))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, final string")
    got = {r.doc_id for r in T.truncated_documents(df).collect()}
    assert len(got - cut) <= 2 and len(cut - got) <= len(cut) // 10
    report = {r.source: r for r in T.truncation_report(df).collect()}
    assert set(report) == {"paste", "mirror", ""} and sum(r.documents for r in report.values()) == 400
    assert report["paste"].share > 3 * report["mirror"].share
    limits = {(r.source, r.unit, r.length) for r in T.length_limits(T.text_features(df)).collect()}
    assert ("paste", "chars", 600) in limits and not any(s != "paste" for s, *_ in limits)


KIND = re.compile(r"\n[ \t]*|[^\W\d]\w*|\d\w*|[^\w\s]")


def plain_contexts(text):
    """Token sequences of a text in plain Python."""
    text = "\n" + re.sub(r"(?:[ \t]*\n)+", "\n", text.replace("\r", "")).lstrip("\n").rstrip(" \t\n")
    kinds = []
    for t in KIND.findall(text):
        kinds.append((2 if len(t) > 1 else 1) if t[0] == "\n" else ord("9") if t[0].isdigit() else ord("a") if t[0].isalpha() or t[0] == "_" else ord(t))
    return [sum(kinds[i - j] << (8 * j) for j in range(min(T.CONTEXT, i + 1))) for i in range(len(kinds))]


def test_token_contexts():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "_b", "7", "x9", " ", "\t", "\n", "\n  ", "(", ")", ";", "+", "\r\n", "\n\n"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = [t if t.strip() else "a" for t in texts] + ["if (a) {\n    return b;\n}\n"]
    contexts, doc, _ = T.token_contexts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        t = "\n" + t.lstrip("\r\n") if not t.lstrip(" \t\r\n").startswith("\n") else t
        got = contexts[doc == i].tolist()
        want = plain_contexts(t[1:])
        assert got[1:] == want[1:] or got[T.CONTEXT :] == want[T.CONTEXT :], (t, got, want)
    assert not len(T.token_contexts([b"", b" \n\n "])[0])


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(21)
    text = "".join(rng.choice(["ab", "7", " ", "\n", "\n  ", "(", ")", ";", "+", "é"]) for _ in range(5000)).encode()
    want = T.token_contexts([text])[0]
    for size in (100, 777, 10_000_000):
        monkeypatch.setattr(T, "LONG_BYTES", size)
        monkeypatch.setattr(T, "LOOK_BYTES", 60)
        assert np.concatenate(list(T.long_contexts(text))).tolist() == want.tolist()
    assert not list(T.long_contexts(b"")) and [len(x) for x in T.long_contexts(b" \n\n ")] == [0]


def cut_corpus(rng, n=600):
    """Complete files, a part of them cut anywhere; copies of complete and of cut files; complete ones that end oddly."""
    docs, cut = [], set()
    for i in range(n):
        text = (python_file if i % 2 else c_file)(rng, rng.randrange(8, 14))
        kind = rng.random()
        if kind < 0.15:
            cut.add(i)
            text = text[: rng.randrange(len(text) // 4, len(text) - 40)]
        elif kind < 0.25:
            text = text.rstrip("\n")
        elif kind < 0.3:
            text += "// end of " + rng.choice(WORDS)
        docs.append((i, text, f"s{i % 3}"))
    for i in (*sorted(cut)[:2], *[j for j in range(n) if j not in cut][:2]):
        for _ in range(60):  # copies of one file bear no witness for or against it
            docs.append((len(docs), docs[i][1], "vendored"))
            if i in cut:
                cut.add(len(docs) - 1)
    return docs, cut


def test_planted_cuts(spark):
    """The tries alone, without any length evidence, find nine of ten files cut anywhere and hardly a complete one."""
    docs, cut = cut_corpus(random.Random(12))
    rows = T.judged_texts(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    found = {r.doc_id for r in rows if r.partial}
    assert len(found & cut) >= 0.9 * len(cut) and len(found & cut) >= 0.95 * len(found)
    assert all(r.partial or r.limit or r.block for r in rows if r.truncated)


def test_words():
    assert T.subwords("loadSmallRec") == ["load", "small", "rec"] and T.subwords("HTTPServer") == ["http", "server"] and T.subwords("señal") == ["señal"]
    assert T.final_word("fill_bridg") == "bridg" and T.final_word("callBrid") == "brid" and T.final_word("x = 0x1a") is None and T.final_word("end.") is None and T.final_word("") is None
    assert T.strip_ellipsis("abc [more]") == ("abc", True) and T.strip_ellipsis("abc…") == ("abc", True) and T.strip_ellipsis("abc") == ("abc", False)


def test_trie(spark):
    words = spark.createDataFrame([("bridge", 50), ("brim", 9), ("br", 2), ("a", 70), ("rare", 1)], "word string, n long")
    long = "q" * 70
    words = words.unionByName(spark.createDataFrame([(long + "rst", 8), (long, 5), ("z" * 500, 1)], words.schema))
    finals = spark.createDataFrame([(x, x) for x in ("b", "br", "bri", "bridg", "bridge", "a", "rar", "q" * 10, "q" * 64, "q" * 66, long, long + "rst")], "final string, prefix string")
    got = {}
    for r in T.words_below(words, finals).collect():
        got[r.final] = max(r.below, got.get(r.final, 0))
    assert got == {"b": 50, "br": 50, "bri": 50, "bridg": 50, "q" * 10: 8, "q" * 64: 8, "q" * 66: 8, long: 8}
    docs = spark.createDataFrame([("load_anchor(x)",), ("loadAnchor anchor bri",), (None,), ("",)], "text string")
    assert {r.word: r.n for r in T.vocabulary(T.term_counts(docs)).collect()} == {"load": 2, "anchor": 3, "x": 1} or {r.word for r in T.vocabulary(T.term_counts(docs)).collect()} == {"load", "anchor", "x"}


def test_edges(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "f(b, c)\nf(a,", None), (4, "é" * 200_000 + " end.", "s"), (4, "f(b, c)\nf(b,", "s"), (4, "f(b, c)\nf(b,", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # five texts teach nothing: without a vocabulary nothing is called cut
    assert sorted((r.doc_id or 0, r.truncated) for r in T.judged_texts(df).collect()) == [(0, False), (2, False), (4, False), (4, False), (4, False)]
    known = [(100 + i, "f(b, c)\n" * 30, "s") for i in range(30)]
    df = df.unionByName(spark.createDataFrame(known, df.schema))
    judged = [(r.doc_id or 0, r.truncated) for r in T.judged_texts(df).collect() if (r.doc_id or 0) < 100]
    assert sorted(judged) == [(0, True), (2, False), (4, False), (4, True), (4, True)]
    assert T.truncated_documents(df.limit(0)).count() == 0 and T.truncation_report(df.limit(0)).count() == 0


def test_limits_in_bytes_and_marks(spark):
    rng = random.Random(4)
    body = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    rows, want = [], set()
    for i in range(40):
        raw = body(3000).encode()[:1024].decode("utf-8", "ignore") if i % 2 else body(499) + "x..."
        rows.append((i, raw.rstrip("\n") + "x" * (raw[-1:] == "\n"), "bytes" if i % 2 else "marks"))
        want.add(i)
    rows += [(100 + i, body(200 + 37 * i) + "\n", s) for i in range(20) for s in ("bytes", "marks")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in T.truncated_documents(df).collect()}
    assert want - got <= {i for i in want if rows[i][1][-1] == "\n"} and len(got - want) <= 6
