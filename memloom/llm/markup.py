"""Markup residue: HTML, Markdown, wiki and LaTeX texts to clean, structured text.

A lexer turns each text into a stream of blocks with the marks found in them;
what stands inside code is code.  Marks whose form leaves no doubt (a fence, a
closed tag, ``**x**``, ``[x](y)``) are sure; forms that prose, code and file names
share (``*x*``, ``_x_``, ``$x$``, a tag that nothing closes, ``{{name}}``,
``= x =``, a bare ``\\name``) are doubtful.  The streams of one host (the first
directory of a page's path) are aligned one after another into a wrapper, a
union-free regular expression of marks by kind of line, text slots, optional
groups and repeated groups; where a doubtful mark aligns with a sure one the
wrapper keeps the sure one.  A doubtful mark is then markup if its host's wrapper
has it as a sure part of that kind of line (its template), else it falls into a
text slot and stays text.  The result has the marks by field and the blocks
(heading, list item, code, formula, table row, quote, text) with their clean text.

A wrapper has at most MAX_NODES nodes; a longer one, the first stream of a host
included, becomes one repeated group of all its marks as options, which loses no
mark and matches every stream that the longer one matched.

Edge cases: null texts, arrays and elements give nothing; an empty text has no
blocks; an unclosed code block runs to the end; unknown tags, paths, prices,
types, matrices and identifiers are text; both line ends are read alike; repeated
rows of a page with the same content give one row.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions.ordered import keep

FAMILIES = ("html", "markdown", "wiki", "latex")
#: Nodes of a wrapper; a longer one becomes one repeated group of optional tokens.
MAX_NODES = 48

# Element names of HTML.
_TAGS = (
    "a abbr address article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav ol option p pre q s samp script section select small source span strike "
    "strong style sub summary sup syntaxhighlight nowiki table tbody td textarea tfoot th thead title tr tt u ul var video"
)
_TAG = re.compile(rf"</?(?:{_TAGS.replace(' ', '|')})(?:\s+[A-Za-z_:][^<>]*|\s*)/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,31}\d{0,2});")
_CODE_BLOCK = re.compile(
    r"(?P<fence>^[ ]{0,3}(?P<mark>`{3,}|~{3,})[^\n`]*(?:\n(?P<body>.*?))?(?:^[ ]{0,3}(?P=mark)[`~]*[ \t]*$|\Z))"
    r"|(?P<pre><(?P<tag>pre|syntaxhighlight|nowiki|source|script|style)\b[^>]*>(?P<inner>.*?)(?:</(?P=tag)>|\Z))"
    r"|(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*\n?(?P<lines>.*?)(?:\\end\{(?P=env)\}|\Z))",
    re.S | re.M | re.I,
)
_MATH_BLOCK = re.compile(
    r"\\begin\{(?P<env>equation|align|gather|multline|displaymath|eqnarray|math)(?P<star>\*?)\}(?P<a>.*?)\\end\{(?P=env)(?P=star)\}|\$\$(?P<b>[^$]+?)\$\$|\\\[(?P<c>.+?)\\\]", re.S
)
_MATH = re.compile(r"\\\((?P<a>.+?)\\\)|(?<![\\$\w])\$(?P<b>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\w$])")
_INLINE_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
_VERB = re.compile(r"\\verb\*?([^\sA-Za-z*])(.*?)\1")
# LaTeX commands that stand without an argument.
_BARE = "item alpha beta gamma delta epsilon lambda mu pi sigma theta omega leq geq neq approx times cdot ldots dots infty log ln exp sum prod int maketitle tableofcontents centering noindent newpage clearpage par hline bigskip medskip smallskip LaTeX TeX left right quad qquad and"
_COMMAND = re.compile(rf"(?<![\w:\\])\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?=\{{)|(?:{_BARE.replace(' ', '|')})(?![A-Za-z\\]))")
_DUNDER = re.compile(r"__(?:init|main|name|file|all|call|str|repr|len|new|del|doc|dict|class|enter|exit|iter|next|eq|hash|getattr|setattr|getitem|setitem|version|slots|module|path|package|future|[a-z]+_[a-z_]+)__")
_EMPHASIS = [
    re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*(?!\*)"),
    re.compile(r"(?<![\w_\\])__(?=[^\s_])(.+?)(?<=[^\s_])__(?![\w_])"),
    re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])"),
    re.compile(r"(?<![\w_\\/])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_/])"),
]
_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])(.+?)(?<=[^\s~])~~(?!~)")
_LINK = re.compile(r"!?\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\(\s*<?[^()\s]*(?:[^()\n]|\([^()\n]*\))*>?\)")
_REF_LINK = re.compile(r"^\s{0,3}\[[^\]\n]+\]:\s+\S+")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_TEMPLATE = re.compile(r"\{\{([^{}\n]+)\}\}")
_QUOTES = re.compile(r"('{2,3}|'{5})(?=[^\s'])([^\n]+?)(?<=[^\s'])\1")
_MD_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_MD_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$")
_MD_ROW = re.compile(r"^\s*\|.*\|\s*$")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+(?=\S)")
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")


def _matrix(inner: str) -> bool:
    return not re.search(r"[^\W\d_]", inner)


_ANY = re.compile(r"[`*_~\[\]{}<>&$\\']")
_VOID = frozenset("br hr img input source".split())
Known = frozenset[str]


def _clean_inline(text: str, marks: set[str], kind: str = "text", known: Known | None = None) -> str:
    """The line without its inline marks, which are added to ``marks`` (doubtful ones with ``?``); what is code or formula stays as it is.

    With ``known`` (the sure marks of the host's wrapper, as ``kind>mark``) doubtful
    marks that aren't among them are left in the text.
    """
    if not _ANY.search(text):
        return re.sub(r"[ \t]{2,}", " ", text).strip() if "  " in text or "\t" in text else text.strip()
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x01"

    def doubt(m: str) -> bool:
        """Whether a doubtful mark is taken out."""
        if known is not None and f"{kind}>{m}" not in known:
            return False
        marks.add(m if known is not None else f"{m}?")
        return True

    def mark(m: str, group: int | None):  # noqa: ANN202
        def take(x: re.Match) -> str:
            marks.add(m)
            return x.group(group) if group else ""

        return take

    def code(x: re.Match) -> str:
        marks.add("markdown:code")
        return keep(f"`{x.group(2)}`")

    def verb(x: re.Match) -> str:
        marks.add("latex:verb")
        return keep(f"`{x.group(2)}`")

    def math(x: re.Match) -> str:
        inner = x.group("a") or x.group("b")
        if x.group("b") is not None and not re.search(r"[\\_^={}+*/<>-]", inner):
            if not re.fullmatch(r"[A-Za-z]\w?", inner) or not doubt("latex:formula"):
                return x.group()
        else:
            marks.add("latex:formula")
        return keep(f"⟦{inner.strip()}⟧")

    if "`" in text:
        text = _INLINE_CODE.sub(code, text)
    if "\\verb" in text:
        text = _VERB.sub(verb, text)
    if "$" in text or "\\(" in text:
        text = _MATH.sub(math, text)
    if "<" in text:
        low = text.lower()

        def tag(x: re.Match) -> str:
            name = re.match(r"</?(\w+)", x.group()).group(1).lower()
            alone = len(name) == 1 and " " not in x.group() and not x.group().startswith("</")
            if alone and x.start() and (text[x.start() - 1].isalnum()) and f"</{name}" not in low[x.end() :]:
                return x.group()
            sure = x.group().startswith("</") or name in _VOID or "=" in x.group() or x.group().endswith("/>") or f"</{name}" in low
            if sure:
                marks.add("html:tag")
            elif not doubt("html:tag"):
                return x.group()
            return " " if name in ("br", "td", "th", "p", "li", "div") else ""

        text = _TAG.sub(tag, text)

    def reference(x: re.Match) -> str:
        plain = html.unescape(x.group())
        if plain == x.group():
            return plain
        marks.add("html:reference")
        return keep(plain.replace("\xa0", " "))

    if "&" in text:
        text = _REFERENCE.sub(reference, text)
    if "](" in text:
        text = _LINK.sub(mark("markdown:link", 1), text)

    def wiki_link(x: re.Match) -> str:
        if _matrix(x.group(1)):
            return x.group()
        marks.add("wiki:link")
        shown = x.group(1).rpartition("|")[2]
        return "" if re.match(r"(?i)category:", x.group(1)) else shown.strip().lstrip("#")

    if "[[" in text:
        text = _WIKI_LINK.sub(wiki_link, text)

    def template(x: re.Match) -> str:
        if re.fullmatch(r"\s*[\w.]+\s*", x.group(1)):
            if not doubt("wiki:template"):
                return x.group()
        else:
            marks.add("wiki:template")
        return x.group(1).rpartition("|")[2] if x.group(1).lower().startswith("note|") else ""

    if "{{" in text:
        text = _TEMPLATE.sub(template, text)
    if "''" in text:
        text = _QUOTES.sub(mark("wiki:emphasis", 2), text)
    if "~~" in text:
        text = _STRIKE.sub(mark("markdown:strike", 1), text)
    if "*" in text or "_" in text:
        if "__" in text:
            text = _DUNDER.sub(lambda x: keep(x.group()), text)
        for n, p in enumerate(_EMPHASIS):
            sign = "**" if n == 0 else "__" if n == 1 else "*" if n == 2 else "_"
            if sign in text:
                text = p.sub(mark("markdown:emphasis", 1) if n < 2 else (lambda x: x.group(1) if doubt("markdown:emphasis") else x.group()), text)

    if "\\" in text and _COMMAND.search(text):
        bare = all(not x.group().endswith(("]", "}")) and text[x.end() : x.end() + 1] != "{" for x in _COMMAND.finditer(text))
        if not bare or "\\item" in text:
            marks.add("latex:command")
        if not bare or "\\item" in text or doubt("latex:command"):
            text = re.sub(r"\\item\b\s*", "", text)
            text = re.sub(r"(?<![\w:\\])\\(?:label|cite|ref|index|vspace|hspace|usepackage|documentclass|input|bibliography|bibliographystyle)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
            while (less := re.sub(r"(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)) != text:
                text = less
            text = re.sub(rf"(?<![\w:\\])\\(?:{_BARE.replace(' ', '|')})(?![A-Za-z\\])", "", text)
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x01", lambda x: kept[int(x.group(1))], text)
    return re.sub(r"[ \t]{2,}", " ", text).strip()


def lex(text: str | None, known: Known | None = None) -> list[dict]:
    """Blocks of a text: kind, level, text and marks (``family:mark``, doubtful ones with ``?`` unless ``known`` decides them)."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "").replace("\x01", "")
    blocks: list[dict] = []

    def add(kind: str, body: str, marks: set[str], level: int = 0) -> None:
        if body or marks:
            blocks.append({"kind": kind, "level": level, "text": body, "marks": sorted(marks)})

    def inline(body: str, marks: set[str], kind: str) -> str:
        return _clean_inline(body, marks, kind, known)

    def lines(part: str) -> None:
        if "<!--" not in part:
            maths(part)
            return
        at = 0
        for m in _COMMENT.finditer(part):
            maths(part[at : m.start()])
            add("comment", "", {"html:comment"})
            at = m.end()
        maths(part[at:])

    def maths(part: str) -> None:
        if "$$" not in part and "\\[" not in part and "\\begin" not in part:
            plain(part)
            return
        at = 0
        for m in _MATH_BLOCK.finditer(part):
            inner = m.group("a") or m.group("b") or m.group("c") or ""
            plain(part[at : m.start()])
            add("formula", inner.strip(), {"latex:formula"} | ({"latex:environment"} if m.group("env") else set()))
            at = m.end()
        plain(part[at:])

    def plain(part: str) -> None:
        table = False
        for line in part.split("\n"):
            stripped = line.strip()
            if not stripped:
                continue
            marks: set[str] = set()
            if stripped.startswith("{|"):
                table = True
                add("table", "", {"wiki:table"})
                continue
            if table:
                if stripped.startswith("|}"):
                    table = False
                    add("table", "", {"wiki:table"})
                elif stripped.startswith("|-"):
                    add("table", "", {"wiki:table"})
                else:
                    cells = [inline(c.strip(), marks, "table") for c in re.split(r"\|\||!!", stripped.lstrip("|!"))]
                    add("table", "\t".join(cells), marks | {"wiki:table"})
                continue
            c = stripped[0]
            if c == "#" and (m := _MD_HEADING.match(line)):
                add("heading", inline(m.group(2), marks, "heading"), marks | {"markdown:heading"}, len(m.group(1)))
            elif c == "=" and (m := _WIKI_HEADING.match(line)) and (m.group(1) != "=" or known is None or "heading>wiki:heading" in known):
                own = {"wiki:heading" if m.group(1) != "=" or known is not None else "wiki:heading?"}
                add("heading", inline(m.group(2), marks, "heading"), marks | own, len(m.group(1)))
            elif c == "<" and (m := re.match(r"(?i)^\s*<h([1-6])\b[^>]*>(.*?)(?:</h\1>)?\s*$", line)):
                add("heading", inline(m.group(2), marks, "heading"), marks | {"html:tag"}, int(m.group(1)))
            elif c == "\\" and (m := _SECTION.match(stripped)) and m.end() >= len(stripped) - 40:
                rest = inline(stripped[m.end() :], marks, "heading")
                depth = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}[m.group(1)]
                add("heading", f"{inline(m.group(2), marks, 'heading')} {rest}".strip(), marks | {"latex:command"}, depth)
            elif c == ">" and re.match(r"^ {0,3}>(?:\s|$)", line):
                add("quote", inline(stripped.lstrip("> "), marks, "quote"), marks | {"markdown:quote"})
            elif "|" in line and _MD_RULE.match(line):
                add("table", "", {"markdown:table"})
            elif c == "|" and _MD_ROW.match(line) and stripped.count("|") >= 2 and not stripped.startswith(("|}", "|-")) and "||" not in stripped:
                cells = [inline(x.strip(), marks, "table") for x in stripped.strip("|").split("|")]
                add("table", "\t".join(cells), marks | {"markdown:table"})
            elif c == "[" and _REF_LINK.match(line):
                add("text", inline(stripped, marks, "text"), marks | {"markdown:link"})
            elif c == "\\" and re.match(r"^\s*\\(?:begin|end)\{[^}]*\}\s*(?:\[[^\]]*\])?\s*$", line):
                add("environment", "", {"latex:environment"})
            elif (c in "-*+•" or c.isdigit()) and (m := _LIST.match(line)):
                add("list", inline(line[m.end() :], marks, "list"), marks)
            elif (c == "<" and re.match(r"(?i)^\s*<li\b", line)) or stripped.startswith("\\item"):
                add("list", inline(stripped, marks, "list"), marks)
            else:
                kind = "table" if c == "<" and re.match(r"(?i)^\s*<(?:table|tr|td|th)\b", line) else "text"
                add(kind, inline(stripped, marks, kind), marks)

    at = 0
    front = re.match(r"\A---\n.*?\n---[ \t]*(?:\n|\Z)", text, re.S)
    if front:
        add("front", front.group().strip("-\n"), set())
        at = front.end()
    blocky = "```" in text or "~~~" in text or "<" in text or "\\begin" in text
    for m in _CODE_BLOCK.finditer(text, at) if blocky else ():
        lines(text[at : m.start()])
        if m.group("fence") is not None:
            add("code", (m.group("body") or "").rstrip("\n"), {"markdown:fence"})
        elif m.group("pre") is not None:
            add("code", html.unescape(re.sub(r"(?i)^<code\b[^>]*>|</code>$", "", m.group("inner").strip("\n"))), {"html:tag"})
        else:
            add("code", m.group("lines").strip("\n"), {"latex:environment"})
        at = m.end()
    lines(text[at:])
    return blocks


def stream(blocks: list[dict]) -> list[str]:
    """Tokens of the blocks: their marks by kind of line (doubtful ones with ``?``) and a text slot; runs are one token."""
    out: list[str] = []
    for b in blocks:
        for token in (*(f"{b['kind']}>{m}" for m in b["marks"]), *([f"{b['kind']}>#text"] if b["text"] else [])):
            if not out or out[-1] != token:
                out.append(token)
    return out


# ---- wrappers: union-free regular expressions over tokens ----
# A node is a token, ["?", nodes] or ["+", nodes].

Node = str | list


def _key(n: Node) -> str:
    """What nodes have in common whether their marks are sure or doubtful."""
    return n.removesuffix("?") if isinstance(n, str) else f"{n[0]}({' '.join(_key(x) for x in n[1])})"


def _merged(a: Node, b: Node) -> Node:
    """The node of two with the same key: sure where one of them is."""
    if isinstance(a, str):
        return a if not a.endswith("?") else b
    return [a[0], [_merged(x, y) for x, y in zip(a[1], b[1], strict=True)]]


def _squeeze(nodes: list[Node]) -> list[Node]:
    """Runs that repeat at once become repeated groups."""
    bare = lambda n: n[1][0] if isinstance(n, list) and len(n[1]) == 1 and n[0] in "?+" else n
    k = 0
    while k < len(nodes):
        for size in (1, 2, 3, 4):
            first = [bare(n) for n in nodes[k : k + size]]
            keys, times = [_key(n) for n in first], 1
            while len(first) == size and [_key(bare(n)) for n in nodes[k + times * size : k + (times + 1) * size]] == keys:
                times += 1
            if times > 1:
                run = nodes[k : k + times * size]
                inner: list[Node] = []
                for i in range(size):
                    own = [run[j * size + i] for j in range(times)]
                    node = bare(own[0])
                    for other in own[1:]:
                        node = _merged(node, bare(other))
                    inner.append(node if all(isinstance(n, str) for n in own) else ["?", [node]])
                nodes = [*nodes[:k], ["+", inner], *nodes[k + times * size :]]
                break
        k += 1
    return nodes


def _leaves(nodes: list[Node]) -> dict[str, str]:
    """The tokens of a wrapper by key, sure where one of them is."""
    out: dict[str, str] = {}
    for n in nodes:
        for t in [n] if isinstance(n, str) else _leaves(n[1]).values():
            out[_key(t)] = _merged(out[_key(t)], t) if _key(t) in out else t
    return out


def _bounded(nodes: list[Node]) -> list[Node]:
    """A wrapper of at most MAX_NODES nodes; a longer one becomes one repeated group of all its tokens as options."""
    return nodes if len(nodes) <= MAX_NODES else [["+", [["?", [t]] for _, t in sorted(_leaves(nodes).items())]]]


def _open(nodes: list[Node]) -> bool:
    """Whether a wrapper is one repeated group of single options, which any stream of its tokens matches."""
    return len(nodes) == 1 and nodes[0][0] == "+" and isinstance(nodes[0][1], list) and all(isinstance(n, list) and n[0] == "?" and len(n[1]) == 1 and isinstance(n[1][0], str) for n in nodes[0][1])


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The wrapper of both: equal nodes stay, a mismatch becomes optional groups in order."""
    if a == b:
        return a
    if _open(a) or _open(b):  # nothing is left to align: the options of both
        known, new = (a, b) if _open(a) else (b, a)
        own, more = _leaves(known), _leaves(new)
        if all(own.get(k) == t or (k in own and t.endswith("?")) for k, t in more.items()):
            return known
        return [["+", [["?", [t]] for _, t in sorted(_leaves([*known, *new]).items())]]]
    optional = lambda part: [n if isinstance(n, list) and n[0] == "?" else ["?", [n]] for n in part]
    out: list[Node] = []
    for op, i, j, x, y in SequenceMatcher(None, [_key(n) for n in a], [_key(n) for n in b], autojunk=False).get_opcodes():
        out += [_merged(m, n) for m, n in zip(a[i:j], b[x:y], strict=True)] if op == "equal" else optional(a[i:j]) + optional(b[x:y])
    return _bounded(_squeeze(out))


def infer(wrapper: list[Node] | None, tokens: list[Node]) -> list[Node]:
    own = _bounded(_squeeze(tokens))
    return align(wrapper, own) if wrapper is not None else own


def template(wrapper: list[Node]) -> Known:
    """The marks by kind of line that a wrapper has for sure; text slots are none."""
    return frozenset(t for t in _leaves(wrapper).values() if not t.endswith(("?", "#text")))


BLOCKS = "array<struct<kind: string, level: int, text: string, marks: array<string>>>"
SCANNED = "rel_path string, host string, field string, kind string, mark string, sure boolean, wrapper string"


def _scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of every page, and at the end a wrapper for each host of the partition (with no path): a bounded state a host."""
    wrappers: dict[str, list[Node]] = {}
    columns = [c.split()[0] for c in SCANNED.split(", ")]
    for part in it:
        rows: dict[tuple, None] = {}
        for path, content, headings in zip(part["rel_path"], part["content"], part["headings"], strict=True):
            host = path.partition("/")[0]
            fields = [("content", lex(content))] + [("headings", lex(h)) for h in (headings if headings is not None else ())]
            for field, blocks in fields:
                if blocks:
                    wrappers[host] = infer(wrappers.get(host), stream(blocks))
                for b in blocks:
                    for m in b["marks"]:
                        rows[(path, host, field, b["kind"], m.removesuffix("?"), not m.endswith("?"), None)] = None
        yield pd.DataFrame([*rows], columns=columns, dtype=object)
    yield pd.DataFrame([(None, h, None, None, None, None, json.dumps(w)) for h, w in wrappers.items()], columns=columns, dtype=object)


def _fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper a host from those of the partitions, with its template; the state is a bounded wrapper a host."""
    wrappers: dict[str, list[Node]] = {}
    for part in it:
        for host, wrapper in zip(part["host"], part["wrapper"], strict=True):
            own = json.loads(wrapper)
            wrappers[host] = align(wrappers[host], own) if host in wrappers else own
    yield pd.DataFrame({"host": [*wrappers], "wrapper": [json.dumps(w) for w in wrappers.values()], "template": [sorted(template(w)) for w in wrappers.values()]}, dtype=object)


def scan_pages(pages: DataFrame) -> DataFrame:
    """The marks of every distinct (path, content, headings) and the partitions' wrappers."""
    own = pages.where(F.col("rel_path").isNotNull()).select("rel_path", "content", "headings").dropDuplicates()
    return own.mapInPandas(_scan, SCANNED)


def wrappers(scans: DataFrame) -> DataFrame:
    """host, wrapper and template (sure marks by kind of line): one row a host, folded over what the partitions gave."""
    own = scans.where(F.col("wrapper").isNotNull()).select("host", "wrapper")
    return own.repartition("host").mapInPandas(_fold, "host string, wrapper string, template array<string>")


def page_markup(pages: DataFrame) -> DataFrame:
    """rel_path, field, kind and mark: the sure marks, and the doubtful ones that the host's wrapper has in its template."""
    # A row a page and kind of mark, read for the wrappers and for the result.
    scans = keep(scan_pages(pages))
    found = scans.where(F.col("rel_path").isNotNull())
    # The doubtful marks of a kind of line are few a host; the template meets them once a host.
    doubtful = found.where(~F.col("sure")).select("rel_path", "host", "field", "kind", "mark")
    token = F.explode("template").alias("token")
    placed = wrappers(scans).select(F.col("host"), token)
    held = doubtful.withColumn("token", F.concat("kind", F.lit(">"), "mark")).join(placed, ["host", "token"], "left_semi")
    out = ["rel_path", "field", "kind", "mark"]
    return found.where("sure").select(*out).unionByName(held.select(*out)).distinct()


def clean_pages(pages: DataFrame) -> DataFrame:
    """rel_path, clean text and blocks of every distinct page content, by the wrapper of its host."""
    own = pages.where(F.col("rel_path").isNotNull() & F.col("content").isNotNull()).select("rel_path", "content").dropDuplicates()
    hosts = wrappers(keep(scan_pages(pages))).select(F.col("host").alias("_host"), "template")

    @F.pandas_udf(BLOCKS)
    def lexed(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, templates in it:
            yield pd.Series([lex(t, frozenset(k if k is not None else ())) for t, k in zip(texts, templates, strict=True)])

    lexed = lexed.asNondeterministic()
    held = own.join(hosts, F.split("rel_path", "/")[0] == F.col("_host"), "left")
    done = held.select("rel_path", lexed("content", "template").alias("blocks"))
    line = lambda b: (
        F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("§"), b["level"]), F.lit(" "), b["text"]))
        .when(b["kind"] == "list", F.concat(F.lit("• "), b["text"]))
        .when(b["kind"] == "code", F.concat(F.lit("⟪code\n"), b["text"], F.lit("\n⟫")))
        .when(b["kind"] == "formula", F.concat(F.lit("⟦"), b["text"], F.lit("⟧")))
        .otherwise(b["text"])
    )
    shown = F.filter("blocks", lambda b: (b["text"] != "") & (b["kind"] != "front"))
    return done.select("rel_path", F.array_join(F.transform(shown, line), "\n").alias("clean"), "blocks")
