import random

import pytest

from memloom.llm import leaks, markup, pii, spam
from memloom.llm.pii_texts import sample
from tests.llm.heldout_pii import sentences


# ---- markup ----

MARKED = [
    ("# Head\n\n- a\n- b", {"markdown"}), ("plain text\n- a bullet\n* another", set()), ("It is **so** and _very_ ~~no~~", {"markdown"}), ("run `x` now", {"markdown"}),
    ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("> quoted", {"markdown"}), ("see [x](y.md)", {"markdown"}), ("== Head ==", {"wiki"}), ("It is ''x'' in [[Page|p]]", {"wiki"}), ("{{note|x}}", {"wiki"}),
    ('{| class="w"\n|-\n| a || b\n|}', {"wiki"}), ("<b>x</b> &amp; y", {"html"}), ("<!-- x -->", {"html"}), ("a &nbsp; b", {"html"}), ("\\section{x} \\emph{y}", {"latex"}), ("so \\(a+b\\) holds", {"latex"}), ("Let $k_1 = 2$ be", {"latex"}),
    ("$$x$$", {"latex"}), ("```\n# x\n[[y]] <b> $a_1$\n```", {"markdown"}), ("<pre># x\n**y**</pre>", {"html"}), ("~~~\n<b>", {"markdown"}), ("\\begin{verbatim}\n<b>\n\\end{verbatim}", {"latex"}),
    ("from $5 to $12", set()), ("It costs $3, R&D pays $7.", set()), ("Vec<String> and Map<K, V>", set()), ("a < b && c > d", set()), ("use a | b or neither", set()), ("call __init__ and load_all_pages", set()), ("C:\\temp\\newdir", set()),
    ("2 * 3 * 4", set()), ("[[1, 2], [3, 4]]", set()), ("C# and #42", set()), ("the set {x}", set()), ("", set()), (None, set()), ("a\r\n\r\n= H =\r\n", {"wiki"}),
]


@pytest.mark.parametrize(("text", "families"), MARKED)
def test_marks(text, families):
    assert {m.partition(":")[0] for b in markup.lex(text) for m in b["marks"]} == families


def test_blocks_keep_structure():
    blocks = markup.lex("## A **b**\n\n1. one\n\n```py\nx = '**'\n```\n\n$$a^2$$\nplain &amp; simple <b>t</b>")
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "A b"), ("list", "one"), ("code", "x = '**'"), ("formula", "a^2"), ("text", "plain & simple t")]


def matches(nodes, tokens):
    """Whether a wrapper matches a stream, by its definition (slow)."""
    if not nodes:
        return not tokens
    n, rest = nodes[0], nodes[1:]
    if isinstance(n, str):
        return bool(tokens) and markup._key(n) == markup._key(tokens[0]) and matches(rest, tokens[1:])
    if n[0] == "?":
        return matches(rest, tokens) or any(matches(n[1], tokens[:k]) and matches(rest, tokens[k:]) for k in range(1, len(tokens) + 1))
    return any(matches(n[1], tokens[:k]) and (matches(rest, tokens[k:]) or matches(nodes, tokens[k:])) for k in range(1, len(tokens) + 1))


def test_wrappers():
    w = markup.infer(markup.infer(None, ["h", "#text", "h", "#text"]), ["h", "list"])
    assert set(markup._leaves(w)) == {"h", "#text", "list"}
    assert markup.align(["a", "b"], ["a", "c"]) == ["a", ["?", ["b"]], ["?", ["c"]]]
    rng, wrapper, streams = random.Random(3), None, []
    for _ in range(200):
        streams.append([rng.choice("abcdefg") for _ in range(rng.randint(0, 90))])
        wrapper = markup.infer(wrapper, streams[-1])
        assert len(wrapper) <= markup.MAX_NODES
    assert set(markup._leaves(wrapper)) == {t for s in streams for t in s}
    small = [["a", "b", "a", "b"], ["a", "b"], ["a", "c", "b"], ["a", "b", "a", "b", "a", "b"]]
    wrapper = None
    for s in small:
        wrapper = markup.infer(wrapper, s)
    assert all(matches(wrapper, s) for s in small)


def test_a_sure_mark_settles_a_doubtful_one():
    w = markup.infer(markup.infer(None, ["text>x?", "text>#text"]), ["text>x", "text>#text"])
    assert w == ["text>x", "text>#text"] and markup.template(w) == {"text>x"}
    assert markup.template(markup.infer(None, ["text>x?", "text>#text"])) == frozenset()


def test_no_stream_is_cut(spark):
    """A page of a thousand changes of block, alone in its host: its last marks count."""
    page = "\n".join(f"- item {k}\nline **{k}**" for k in range(500)) + "\n\\\\section{End}\n"
    df = spark.createDataFrame([("h/a.md", page.replace("\\\\", "\\"), ["== x =="])], "rel_path string, content string, headings array<string>")
    assert {(r.field, r.mark) for r in markup.page_markup(df).collect()} == {("content", "markdown:emphasis"), ("content", "latex:command"), ("headings", "wiki:heading")}


def test_wrappers_decide(spark):
    """A doubtful mark is markup in a host whose wrapper has it for sure in such lines, and text elsewhere."""
    rows = [("a/1", "the *x* file", None), ("a/2", "it is **so**", None), ("b/1", "the *x* file", None), ("b/2", "- it is **so**", None), ("c/1", "cost is $n$ or {{name}}", None), ("c/2", "so $a+b$ holds", None)]
    df = spark.createDataFrame(rows, "rel_path string, content string, headings array<string>")
    got = {(r.rel_path, r.mark) for r in markup.page_markup(df).collect()}
    assert got == {("a/1", "markdown:emphasis"), ("a/2", "markdown:emphasis"), ("b/2", "markdown:emphasis"), ("c/1", "latex:formula"), ("c/2", "latex:formula")}
    clean = {r.rel_path: r.clean for r in markup.clean_pages(df).collect()}
    assert clean["a/1"] == "the x file" and clean["b/1"] == "the *x* file" and clean["c/1"] == "cost is ⟦n⟧ or {{name}}"


def test_pages(spark):
    rows = [("d/a.md", "# x", ["`h`", None, ""], 1), ("d/a.md", "# x", ["`h`", None, ""], 1), ("d/b.md", None, None, 1), ("e/c.md", "<p>x</p>", [], 1), (None, "# y", None, 1), ("f", "", ["plain"], 1)]
    df = spark.createDataFrame(rows, "rel_path string, content string, headings array<string>, host int")
    got = {(r.rel_path, r.field, r.mark.partition(":")[0]) for r in markup.page_markup(df).collect()}
    assert got == {("d/a.md", "content", "markdown"), ("d/a.md", "headings", "markdown"), ("e/c.md", "content", "html")}
    assert markup.page_markup(df.limit(0)).count() == 0 and markup.clean_pages(df).count() == 3


# ---- leaks ----


def brute(docs, items, n=12):
    out = set()
    for i, t in items:
        w = leaks.words_of(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, x in docs:
            v = leaks.words_of(x)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of"] * 20
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for k in range(80)] + [(90, None), (91, ""), (3, "short"), (None, "x " * 20)]
    docs = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 12))
            words[(p := rng.randint(0, len(words))) : p] = w[a : a + rng.randint(8, 20)]
        docs.append((k, rng.choice([" ", "\n", " -- "]).join(words).upper()))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    expected = brute([d for d in docs if d[1]], [i for i in items if i[1] and i[0] is not None])
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert expected and {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()} == expected
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i, block_items=17).collect()} == expected
    assert leaks.leaked_items(d, i.limit(0)).count() == 0 and leaks.leaked_items(d.limit(0), i).count() == 0


# ---- spam ----

LISTED = [
    "Tags: best router; cheap router; router 2024; SKU-12 router; fast router; router near me; top router",
    "https://a.example/x?id=1 best\nhttps://b.example/y?id=2\nhttps://c.example/z",
    '<a href="http://x.example/1">best lamp</a> <a href="http://x.example/2">cheap lamp</a>',
    "#bestLamp #cheapLamp #newLamp #topLamp", "» [lamp](https://x.example/1)\n* [desk](https://x.example/2)\n- [mat](https://x.example/3)",
    "ring light\nbest ring light\ncheap ring light\nring light\nnew ring light", "Ring light fast ring light new best ring light. Ring light best ring light top ring light.", "best lamp | cheap lamp | lamp 2024 | lamp | top lamp",
]
PROSE = [
    "When the router is slow, the team reads the log. It is what we saw.", "2024-01-01 INFO router took=3ms\n2024-01-02 WARN cache took=4ms\n2024-01-02 WARN cache took=4ms", '{"a": 1, "b": 2}\n{"a": 1, "b": 2}', "```\nx = 1\ny = 2\nx = 1\n```",
    "When the router fails the router is slow. Because the router fails the router is slow.", "Glossary\nrouter: a thing that routes what we have.\ncache: a thing that keeps what was seen.", "索引を確認してください。手順書が見つかりません。", "", "...",
]


#: As they would be learnt from prose.
COMMON = {w: w in ("the", "a") for w in "the a an is it of and to that what we in was by then because when".split()}


@pytest.mark.parametrize("text", LISTED)
def test_listed(text):
    assert spam.listed_share(text, COMMON) > 0.5


@pytest.mark.parametrize("text", PROSE)
def test_not_listed(text):
    assert spam.listed_share(text, COMMON) <= 0.5


def test_stuffed_pages(spark):
    rng = random.Random(2)
    nouns = "router cache index log page team file entry query shard answer draft".split()
    prose = lambda: " ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was read by {rng.choice(nouns)} and then it is {rng.choice(nouns)}." for _ in range(rng.randint(2, 12)))
    rows = [(k, prose(), "en", 1) for k in range(120)] + [(1000 + k, t, rng.choice(["en", None, "EN "]), 1) for k, t in enumerate(LISTED)] + [(2000, None, "en", 1), (2001, "", None, 1), (1000, LISTED[0], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    assert {r.doc_id for r in spam.stuffed_pages(df).collect()} == {1000 + k for k in range(len(LISTED))}
    assert spam.stuffed_pages(df.limit(0)).count() == 0


def test_curves_decide(spark):
    """A page that looks like a list to the line check but is written like the language's prose is no case; without the curves it would be one."""
    rng = random.Random(4)
    nouns = "flour butter honey bread milk salt sugar cream yeast water rice lemon".split()
    prose = lambda: " ".join(f"Then {rng.choice(nouns)} and {rng.choice(nouns)} with {rng.choice(nouns)}, {rng.choice(nouns)} or {rng.choice(nouns)}." for _ in range(rng.randint(5, 9)))
    recipe = "\n".join(f"{rng.choice(nouns)} with {rng.choice(nouns)}\nthen {rng.choice(nouns)} and {rng.choice(nouns)}\n{rng.choice(nouns)} or {rng.choice(nouns)}" for _ in range(5))
    stuffed = "Tags: " + "; ".join(f"lamp {w}" for w in "cheap best new top fast pro deal shop sale free online review".split())
    rows = [(k, prose(), "en") for k in range(260)] + [(1000, recipe, "en"), (1001, stuffed, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in spam.stuffed_pages(df).collect()} == {1001}
    off = {k: -1e9 for k in spam.EXTREME}
    assert {r.doc_id for r in spam.stuffed_pages(df, limits=off).collect()} == {1000, 1001}


# ---- personal information ----


@pytest.fixture(scope="module")
def fitted():
    return pii.model()


def spans(text, fitted, lexicon=None):
    return [(pii.TYPES[k], text[s:e]) for k, s, e in pii.find([text], lexicon or {"mara": 1, "quorn": 2, "maple": 1, "harbor": 2}, fitted)[0]]


def test_held_out_accuracy(fitted):
    rng, right, found, true = random.Random(1234), 0, 0, 0
    for _ in range(400):
        text, own, lexicon = sample(rng)
        got = set(pii.find([text], lexicon, fitted)[0])
        right, found, true = right + len(got & set(own)), found + len(got), true + len(own)
    assert right / found > 0.95 and right / true > 0.93


def test_hand_written_sentences(fitted):
    """Sentences in seven languages that nothing was fitted on, with a lexicon that knows none of their names."""
    right = found = true = 0
    texts = sentences()
    assert len(texts) >= 200
    for (text, own), got in zip(texts, pii.find([t for t, _ in texts], {}, fitted), strict=True):
        got = [(pii.TYPES[k], text[s:e]) for k, s, e in got]
        right, found, true = right + sum(g in own for g in got), found + len(got), true + len(own)
    assert right / true >= 0.9 and right / found >= 0.9


FOUND = [
    ("cc mara.quorn@mail.example.org on it", [("email", "mara.quorn@mail.example.org")]), ("reply to mara [at] post [dot] example [dot] net today", [("email", "mara [at] post [dot] example [dot] net")]),
    ("Call me on +44 7700 900123 when done", [("phone", "+44 7700 900123")]), ("text 555-0182 ext. 33 instead", [("phone", "555-0182 ext. 33")]), ("For the form: SSN: 961-58-2763.", [("id_number", "961-58-2763")]),
    ("ticket number 961-58-2763 is closed", []), ("invoice 669104-4237 was paid", []), ("see git@code.invalid:a/notes.git", []), ("I live at 12 North Elm Street, Apt 8 now", [("street_address", "12 North Elm Street, Apt 8")]),
    ("deliver to 145 bis, rue des Lilas please", [("street_address", "145 bis, rue des Lilas")]), ("78 Road map items remain.", []), ("Assigned to Mara Quorn.", [("person_name", "Mara Quorn")]), ("the Maple Harbor service is up", []), ("", []),
]


@pytest.mark.parametrize(("text", "expected"), FOUND)
def test_found(text, expected, fitted):
    assert spans(text, fitted) == expected


def test_json_places():
    raw = '{"a": "x \\u00e9\\n\\"y\\"", "b": "\\ud83d\\ude00 cut o'
    decoded = pii.json_strings(raw)
    assert [t for t, _ in decoded] == ["a", 'x é\n"y"', "b", "😀 cut o"]
    for text, places in decoded:
        assert len(places) == len(text) + 1
    assert pii.json_strings("plain")[0][0] == "plain"


def test_redact(spark):
    rows = [("a", 'mail mara@mail.example.org now', False, 1), ("b", '{"out": "Call me on +44 7700 900123 when\\nthe job ends"', True, 1), ("c", None, False, 1), ("d", "", True, 1), ("a", 'mail mara@mail.example.org now', False, 1)]
    df = spark.createDataFrame(rows, "id string, text string, is_json boolean, found_text int")
    lexicon = spark.createDataFrame([("Mara", "given"), (None, "family")], "name string, kind string")
    got = {r.id: r for r in pii.redact(df, lexicon).collect()}
    assert got["a"].redacted == "mail [EMAIL] now" and got["b"].redacted == '{"out": "Call me on [PHONE] when\\nthe job ends"'
    assert got["c"].redacted is None and got["c"].found == [] and got["d"].redacted == ""
    assert pii.redact(df.limit(0), lexicon).count() == 0


def test_a_lexicon_of_any_size(spark):
    """The names of a large lexicon meet the texts by a join; both ways give the same."""
    texts = ["assigned to mara quorn", '{"who": "ping Z\\u00e9lie quorn first"', "nothing here", None, "assigned to mara quorn"]
    df = spark.createDataFrame([(k, t, k == 1) for k, t in enumerate(texts)], "id int, text string, is_json boolean")
    lexicon = spark.createDataFrame([("Mara", "given"), ("Zélie", "given"), ("Quorn", "family"), ("quorn", "given"), *[(f"Name{k}", "given") for k in range(2000)]], "name string, kind string")
    ways = [{r.id: (r.redacted, [tuple(x) for x in r.found]) for r in pii.redact(df, lexicon, lexicon_rows=n).collect()} for n in (100_000, 10)]
    assert ways[0] == ways[1] and len(ways[0]) == len(texts)
