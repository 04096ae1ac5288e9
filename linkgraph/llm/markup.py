"""Markup residue in text fields: HTML, Markdown, wiki and LaTeX pieces, whole or broken.

A text is read into a tree of elements of all four languages (tags, comments, templates, links,
tables, blocks of lines, LaTeX blocks, single marks); what is opened and not closed, or closed and
never opened, is a node as well. A text holds markup if its tree has a node. The hash of a subtree
is counted over the pages of its host (a group of pages made from one template, told by the
caller); subtrees of containers that recur on many pages of a host are boilerplate and deleted,
but not line breaks, links, headings, list items, code or formulas, nor what holds headings, code
or formulas. What remains is converted to plain text that keeps headings as lines of their own,
list items after a bullet, code indented, table cells apart by tabs and formulas between dollar
signs.
"""

from __future__ import annotations

import html
from collections import Counter
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.operators.skew import join_unique
from linkgraph.plans.session import BROADCAST_ROWS, checkpointed

#: A subtree is boilerplate if it is on at least so many pages of its host and on this share of them.
RECUR_PAGES, RECUR_SHARE = 20, 0.01

#: File paths, in which a backslash is no markup.
_PATH = regex.compile(r"(?<![\w\\])[A-Za-z]:\\[\w\\.-]*")
_LINE = r"(?<=^[ \t]*)"
_VOID = {"br", "hr", "img", "references", "wbr", "input", "meta", "link"}


def _rules(table: dict[str, list[tuple[str, str, str]]]) -> dict[str, list[tuple[str, str, regex.Pattern]]]:
    return {sign: [(kind, role, regex.compile(p, regex.M)) for kind, role, p in rules] for signs, rules in table.items() for sign in signs}


#: The tokens of the four languages by their first sign: kind, role in the tree (open, close, tag, leaf, or line: a mark at the front of
#: a line of a block; none: plain text) and pattern. What a pattern only looks ahead at is read on its own afterwards.
_TOKENS = _rules({
    "<": [
        ("html comment", "open", r"<!--"), ("html tag", "tag", r"<(?P<close>/?)(?P<tag>[A-Za-z][\w:-]*)(?:\s[^<>]*?)?(?P<self>/?)>"), ("html tag", "leaf", r"<[/!]?[A-Za-z]\w*"),
    ],
    "-": [("html comment", "close", r"-->"), ("markdown list", "line", rf"{_LINE}-(?=[ \t]+\S)")],
    "/": [("html tag", "leaf", r"/>")],
    '"': [("html tag", "leaf", r'"\s*>')],
    "&": [("html reference", "leaf", r"&(?:#\d+|#[xX][\da-fA-F]+|[A-Za-z][A-Za-z\d]{1,30});|&(?:nbsp|amp|lt|gt|quot|ndash|mdash|hellip|rsquo|lsquo|#\d{2,6})\b")],
    "[": [("wiki link", "open", r"\[\["), ("wiki link", "leaf", r"\[(?=(?:https?|ftp)?://|https?:)")],
    "]": [("wiki link", "close", r"\]\]"), ("markdown link", "leaf", r"\]\(")],
    "{": [("wiki template", "open", r"\{\{"), ("wiki table", "open", r"\{\|")],
    "}": [("wiki template", "close", r"\}\}")],
    "|": [
        ("wiki table", "close", r"\|\}"), ("wiki table", "leaf", r"\|\|"), ("markdown table", "line", rf"{_LINE}\|(?=.*\|[ \t]*$)"), ("wiki table", "leaf", rf"{_LINE}\|-"), ("markdown table", "leaf", r"\|(?=[ \t]*:?-{3,})"),
    ],
    "!": [("wiki table", "leaf", r"!!"), ("markdown link", "leaf", r"!(?=\[)")],
    "'": [("wiki quotes", "leaf", r"''+")],
    "=": [("wiki heading", "line", rf"{_LINE}={{2,6}}(?=[^=\n])"), ("wiki heading", "leaf", r"(?<=[^=\n])={2,6}(?=[ \t]*$)")],
    "_": [
        ("wiki switch", "leaf", r"__[A-Z]{3,}__"), ("markdown strong", "leaf", r"(?<!\w)__(?=\w)|(?<=\w)__(?!\w)|__[^\s_]+__"),
        ("markdown emphasis", "leaf", r"(?<!\w)_(?=[^\s_][^_\n]*(?<!\s)_(?!\w))"),
    ],
    "*#:;+>0": [
        ("wiki list", "line", rf"(?<=^)[*#:;]+(?=[ \t]+\S)"), ("markdown heading", "line", r"(?<=^[ ]{0,3})#{1,6}(?=[ \t]+\S)"), ("markdown list", "line", rf"{_LINE}\+(?=[ \t]+\S)"),
        ("markdown quote", "line", rf"{_LINE}>(?=\s|$)"), ("markdown strong", "leaf", r"\*\*"),
        ("markdown emphasis", "leaf", r"(?<![\w*])\*(?=[^\s*][^*\n]*(?<!\s)\*(?![\w*]))"), ("markdown list", "line", r"^[ \t]*\d+[.)](?=[ \t]+\S)"),
    ],
    "~": [("markdown strong", "leaf", r"~~")],
    "`": [("markdown code", "leaf", r"`+")],
    "$": [("latex formula", "leaf", r"\$\$|\$(?=[^\s$](?:[^$\n]*[^\s$])?\$(?!\d))")],
    "\\": [
        ("", "none", r"(?<=(?<![\w\\])[A-Za-z]:)\\[\w\\.-]*"), ("latex block", "open", r"\\begin\{(?P<name>\w+\*?)\}"), ("latex block", "close", r"\\end\{(?P<name>\w+\*?)\}"),
        ("latex command", "leaf", r"\\[A-Za-z]+|\\[()\[\]{}$%&#]"),
    ],
})
_SIGN = regex.compile(r"""[<"/&\[\]{}|!'=_*#:;+>~`$\\-]|^[ \t]*\d+[.)]""", regex.M)
_BLANKS = regex.compile(r"\s+")


def parse(text: str | None) -> list[tuple[int, int, str, int | None]]:
    """(start, end, kind, hash) of the nodes of a text's tree of elements; none for a null or empty text.

    Whole elements, blocks of lines and single marks have the hash of their subtree, which is made of
    their own text between their children, blanks squeezed, and of their children's hashes, so it is
    computed once whatever the depth. What is opened and not closed (it ends where its parent does),
    or closed and never opened, is a node too, without a hash.
    """
    out: list[tuple[int, int, str, int | None]] = []
    if not text:
        return out
    stack: list[list] = []  # closing token, kind, start, end of the opening token, place up to which own text is taken in, hasher
    waiting: Counter = Counter()  # closing tokens on the stack
    lines: list = []  # kind, start and end of the block of lines at hand

    def put(until: int, child: int | None = None, after: int = 0) -> None:
        if stack:
            top = stack[-1]
            top[5].update(_BLANKS.sub(" ", text[top[4] : until]).encode())
            if child is not None:
                top[5].update(child.to_bytes(8, "little"))
            top[4] = after

    def end_block() -> None:
        if lines:
            kind, a, b = lines
            out.append((a, b, kind, xxhash.xxh3_64_intdigest(_BLANKS.sub(" ", text[a:b]).encode())))
            lines.clear()

    def leave_open() -> None:
        closing, kind, start, opened, place, _ = stack.pop()
        waiting[closing] -= 1
        out.append((start, opened, kind, None))
        if stack:  # its text belongs to the parent
            stack[-1][4] = min(stack[-1][4], start)

    at = 0
    while m := _SIGN.search(text, at):
        i, sign = m.start(), m[0][0]
        found = None
        for kind, role, pattern in _TOKENS["0" if len(m[0]) > 1 or sign in " \t0123456789" else sign]:
            if found := pattern.match(text, i):
                break
        if not found:
            at = m.end()
            continue
        at = found.end()
        if role == "none":
            continue
        if role == "line":
            start = text.rfind("\n", 0, i) + 1 if i else 0
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            if lines and lines[0] == kind and start <= lines[2] + 1:
                lines[2] = max(lines[2], stop)
            else:
                end_block()
                lines[:] = [kind, start, stop]
            continue
        closing = None
        if role == "tag":
            name = found["tag"].lower()
            void = not found["close"] and (found["self"] or name in _VOID)
            role, closing = ("leaf" if void else "close" if found["close"] else "open"), "<" + name
        elif kind == "latex block":
            closing = "\\" + found["name"]
        elif role != "leaf":
            closing = kind
        if role == "open":
            stack.append([closing, kind, i, at, i, xxhash.xxh3_64()])
            waiting[closing] += 1
        elif role == "leaf":
            h = xxhash.xxh3_64_intdigest(_BLANKS.sub(" ", text[i:at]).encode())
            out.append((i, at, kind, h))
            put(i, h, at)
        elif waiting[closing]:
            while stack[-1][0] != closing:
                leave_open()
            put(at, None, at)
            _, kind, start, _, _, hasher = stack.pop()
            waiting[closing] -= 1
            h = hasher.intdigest()
            out.append((start, at, kind, h))
            put(start, h, at)
        else:
            out.append((i, at, kind, None))
    end_block()
    while stack:
        leave_open()
    return out


def pieces(text: str | None) -> list[str]:
    """The kinds of markup that a text holds."""
    return sorted({n[2] for n in parse(text)})


def subtrees(text: str) -> list[tuple[int, int, str, int]]:
    """The nodes that are whole."""
    return [n for n in parse(text) if n[3] is not None]


#: Page furniture, whatever it holds; and blocks that may hold content.
_FURNITURE = regex.compile(r"<(?:nav|header|footer|aside|form|script|style|noscript)\b", regex.I)
_BLOCK = regex.compile(r"<(?:div|section|article|main|table|center|blockquote|p|gallery|figure)\b|\\begin\{(?:figure|center|minipage|titlepage)\*?\}|\{\||\{\{(?P<template>[^|{}]*+)", regex.I)
_CONTAINER_KINDS = {"html tag", "wiki template", "wiki table", "markdown quote", "latex block"}
#: What is kept whatever recurs: headings, code and formulas.
_KEPT = regex.compile(r"<(?:h[1-6]|pre|code|source|syntaxhighlight|math)\b|^[ \t]*={2,6}[^=\n]|^[ ]{0,3}#{1,6}[ \t]+\S|```|\$|\\[\[(]|\\(?:sub)*section\b|\\begin\{(?!(?:figure|center|minipage|titlepage)\b)|\{\{[ \t]*(?:math|code)\b", regex.M | regex.I)


def containers(text: str, nodes: list[tuple[int, int, str, int | None]]) -> list[tuple[int, int, int]]:
    """(start, end, hash) of those of a text's whole nodes that may be deleted as boilerplate."""
    whole = [n for n in nodes if n[3] is not None and n[2] in _CONTAINER_KINDS]
    kept = [m.start() for m in _KEPT.finditer(text)] if whole else []
    out = []
    for a, b, kind, h in whole:
        if _FURNITURE.match(text, a):
            out.append((a, b, h))
        elif kind == "markdown quote" or (m := _BLOCK.match(text, a)):
            name = "" if kind == "markdown quote" else (m["template"] or "").strip().lower()
            at = bisect_left(kept, a)
            if name not in _TEXT_TEMPLATES and not name.startswith("formatnum:") and (at == len(kept) or kept[at] >= b):
                out.append((a, b, h))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans, which may be nested."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def n_within(nodes: list[tuple[int, int, str, int | None]], spans: list[tuple[int, int]]) -> int:
    """How many of the whole nodes lie in a span; spans may be nested."""
    n, end, left = 0, -1, sorted(spans, reverse=True)
    for a, b in sorted((a, b) for a, b, _, h in nodes if h is not None):
        while left and left[-1][0] <= a:
            end = max(end, left.pop()[1])
        n += b <= end
    return n


_REF = regex.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>(?:(?!</?ref\b).)*</ref>|<!--(?:(?!-->|<!--).)*-->|</?references\b[^<>]*>|__[A-Z]{3,}__", regex.S | regex.I)
_CODE = regex.compile(r"```[^\n`]*\n(?P<a>.*?)```|<pre[^<>]*>\s*(?:<code[^<>]*>)?(?P<b>(?:(?!</?pre\b|</code>).)*)(?:</code>)?\s*</pre>|<(?:source|syntaxhighlight)[^<>]*>(?P<c>(?:(?!</?(?:source|syntaxhighlight)\b).)*)</(?:source|syntaxhighlight)>|\\begin\{(?:verbatim|lstlisting)\}(?P<d>(?:(?!\\(?:begin|end)\{(?:verbatim|lstlisting)).)*)\\end\{(?:verbatim|lstlisting)\}", regex.S | regex.I)
_FORMULA = regex.compile(
    r"<math[^<>]*>(?P<a>(?:(?!</?math\b).)*)</math>|\$\$(?P<b>[^$]+)\$\$|\\\[(?P<c>(?:(?!\\[\[\]]).)+)\\\]|\\\((?P<d>(?:(?!\\[()]).)+)\\\)|\\begin\{(?:equation|align|gather|displaymath|math)\*?\}(?P<e>(?:(?!\\(?:begin|end)\{).)*)\\end\{\w+\*?\}|\$(?P<f>[^\s$](?:[^$\n]*[^\s$])?)\$(?!\d)",
    regex.S | regex.I,
)
_TABLE_ROW = regex.compile(r"(?m)^[ \t]*\|(?!-|\})(.*?)\|?[ \t]*$")
_SPLIT = regex.compile(r"(\{\{|\}\}|\[\[|\]\]|\n)")
#: Templates whose arguments are text.
_TEXT_TEMPLATES = {"nowrap", "convert", "ubl", "lang", "small", "nobr", "plainlist", "flatlist", "hlist", "unbulleted list", "abbr"}


def _template(body: str) -> str:
    name, *rest = body.split("|")
    name = name.strip().lower()
    if name.startswith("formatnum:"):
        return body.partition(":")[2].strip()
    values = [r.strip() for r in rest if r.strip() and "=" not in r]
    if name not in _TEXT_TEMPLATES or not values:
        return ""
    if name == "convert":
        return " ".join(values[:2])
    return values[-1] if name == "lang" else values[0] if name == "abbr" else ", ".join(values)


def _link(body: str) -> str:
    head, _, label = body.partition("|")
    kind = head.strip().lower().partition(":")[0]
    if kind in ("file", "image", "category", "media") and ":" in head and not head.strip().startswith(":"):
        return ""
    return label.rpartition("|")[2] if label else head.strip().lstrip(":")


_OPENS = {"{{": "}}", "[[": "]]"}


def _braces(text: str) -> str:
    """Templates and links, nested to any depth, in one pass; what is left open ends with its line."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    for t in _SPLIT.split(text):
        if t in _OPENS:
            stack.append((t, []))
        elif t in ("}}", "]]"):
            if _OPENS.get(stack[-1][0]) == t:
                kind, parts = stack.pop()
                stack[-1][1].append((_template if kind == "{{" else _link)("".join(parts)))
        elif t == "\n" and len(stack) > 1 and stack[-1][0] == "[[":
            while len(stack) > 1:
                _, parts = stack.pop()
                stack[-1][1].append("".join(parts).rpartition("|")[2])
            stack[-1][1].append(t)
        else:
            stack[-1][1].append(t)
    while len(stack) > 1:
        _, parts = stack.pop()
        stack[-1][1].append("".join(parts).rpartition("|")[2])
    return "".join(stack[0][1])


def _sub(pairs: list[tuple[str, str]]) -> list[tuple]:
    return [(regex.compile(a, regex.M), b) for a, b in pairs]


_STRUCTURE = _sub([
    (r"(?i)<h[1-6][^<>]*>\s*(.*?)\s*</h[1-6]>", r"\n\1\n"),
    (r"^[ \t]*={2,6}[ \t]*([^=\n].*?)[ \t]*={2,6}[ \t]*$", r"\1"),
    (r"^[ \t]*={2,6}[ \t]*(?=[^=\s])|(?<=[^=\s])[ \t]*={2,6}[ \t]*$", ""),
    (r"^[ ]{0,3}#{2,6}[ \t]+(.*?)[ \t]*#*$", r"\1"),
    (r"\\(?:sub)*section\*?\{([^{}]*)\}", r"\n\1\n"),
    (r"(?i)<li[^<>]*>[ \t]*", "\n• "), (r"\\item\b[ \t]*(?:\[[^\]]*\])?", "\n• "), (r"\\(?:begin|end)\{\w+\*?\}(?:\[[^\]]*\])?", "\n"),
    (r"(?i)</?(?:ul|ol|li|p|div|blockquote|section|table|tbody|thead|dl|dt|dd)\b[^<>]*>", "\n"),
    (r"(?i)</t[dh]>\s*<t[dh][^<>]*>", "\t"), (r"(?i)<tr[^<>]*>|</tr>", "\n"), (r"(?i)<br\b[^<>]*>", "\n"),
    (r"^[ \t]*[*#:;]+[ \t]+(?=\S)", "• "), (r"^[ \t]*[-+][ \t]+(?=\S)", "• "), (r"^[ \t]*\d+[.)][ \t]+(?=\S)", "• "),
    (r"^[ \t]*>[ \t]?", ""),
    (r"^[ \t]*\{\|.*$|^[ \t]*\|\}[ \t]*$|^[ \t]*\|-.*$|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", ""),
    (r"^[ \t]*!(.*)$", r"|\1"), (r"(?<![ \t])[ \t]*+(?:!!|\|\|)[ \t]*", " | "),
])
_INLINE = _sub([
    (r"!?\[([^\[\]]*)\]\([^()\s]*\)?", r"\1"), (r"\[(?:(?:https?|ftp):)?//[^\s\]]*[ \t]*([^\[\]]*)\]?", r"\1"),
    (r"~?\\(?:cite|ref|label|eqref|pageref|footnote|includegraphics)\w*(?:\[[^\]]*\])?\{[^{}]*\}?", ""),
    (r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1"), (r"\\[A-Za-z]+\*?\{?", ""), (r"\\([()\[\]{}$%&#])", r"\1"),
    (r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>|</?[A-Za-z]\w*(?:[ ]\w+=\S*)*", ""),
    (r"'''?|\*\*|~~|`+", ""), (r"__([^\s_]+)__", r"\1"), (r"(?<!\w)__(?=\w)|(?<=\w)__(?!\w)", ""),
    (r"(?<![\w*])\*([^\s*][^*\n]*(?<!\s))\*(?![\w*])", r"\1"), (r"(?<!\w)_([^\s_][^_\n]*(?<!\s))_(?!\w)", r"\1"),
])
_LEFT = regex.compile(r"<!--|-->|</?[A-Za-z][\w]*>?|/>|\"\s*>|\[\[|\]\]|\{\{|\}\}|\{\||\|\}|''+|\*\*|~~|`|!\[|\]\(|\$\$|\\[A-Za-z]+|\\[()\[\]{}$%&#]|\|\||!!|\[(?:https?|ftp)?:?//|\[https?:|\|\s*:?-{3,}")


def clean(text: str) -> str:
    """A text without markup; see the module for what is kept. Formulas and code are kept verbatim."""
    kept: list[str] = []

    def keep(form: str):
        def put(m) -> str:
            body = next((g for g in m.groups() if g is not None), "").strip("\n")
            if form == "code":
                kept.append("\n" + "\n".join("    " + x for x in html.unescape(body).split("\n")) + "\n")
            else:
                kept.append(f"${regex.sub(r'\s+', ' ', body).strip()}$")
            return f"\uE000{len(kept) - 1}\uE001"

        return put

    def hide(m) -> str:
        kept.append(m[0])
        return f"\uE000{len(kept) - 1}\uE001"

    t = text.replace("\uE000", "").replace("\uE001", "")
    t = _PATH.sub(hide, t)
    t = _CODE.sub(keep("code"), t)
    t = _FORMULA.sub(keep("formula"), _REF.sub("", t))
    t = _braces(t)
    for p, by in _STRUCTURE:
        t = p.sub(by, t)
    t = _TABLE_ROW.sub(lambda m: "\t".join(x.strip() for x in m[1].split("|")), t)
    for p, by in _INLINE:
        t = p.sub(by, t)
    t = html.unescape(html.unescape(t)).replace("\xa0", " ")
    while _LEFT.search(t) or parse(t):
        before, t = t, _LEFT.sub("", t)
        for p, by in _STRUCTURE + _INLINE:
            t = p.sub(by, t)
        if len(t) >= len(before):  # every pass must shorten the text
            break
    t = regex.sub(r"\uE000(\d+)\uE001", lambda m: kept[int(m[1])], t)
    t = regex.sub(r"(?<![ \xa0])[ \xa0]++(?=\n|\Z)", "", regex.sub(r"(?<=\S) {2,}", " ", t))
    return regex.sub(r"\n{3,}", "\n\n", t).strip("\n")


def clean_fields(texts: DataFrame) -> DataFrame:
    """host, page_id, section_no, n_kinds, n_removed, clean of every non-null text.

    texts: host STRING (not null), page_id BIGINT, section_no INT, text STRING. n_kinds counts the
    kinds of nodes in the tree of a text (0: it is left as it is), n_removed the nodes deleted as
    boilerplate, those inside of others included. Two passes over the texts; between them the
    subtrees of containers are counted over the pages of each host, and those that recur are joined
    to the texts that hold them.
    """
    key = F.xxhash64("host", "text").alias("key")
    present = texts.where("text is not null").select("host", "page_id", "section_no", "text", key)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, p, k, x - (1 << 63)) for h, p, t, k in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True) for x in {x for _, _, x in containers(t, parse(t))}]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "page_id", "key", "subtree"])

    pages = present.select("host", "page_id").distinct().groupBy("host").agg(F.count("page_id").alias("n_pages"))
    found = checkpointed(present.mapInArrow(hashes, "host string, page_id bigint, key bigint, subtree bigint").withColumn("which", F.concat_ws("\t", "host", "subtree")))
    counts = found.select("host", "page_id", "which").distinct().groupBy("host", "which").agg(F.count("page_id").alias("n")).where(F.col("n") >= RECUR_PAGES)
    often = checkpointed(counts.join(pages, "host").where(F.col("n") >= RECUR_SHARE * F.col("n_pages")).select("which"))
    gone = checkpointed(join_unique(found.select("key", "subtree", "which"), often, "which").groupBy("key").agg(F.collect_set("subtree").alias("gone")))
    n = gone.count()
    told = present.join(F.broadcast(gone), "key", "left") if n <= BROADCAST_ROWS else join_unique(present, gone, "key", "left")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, removed, out = [], [], []
            for t, some in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                nodes = parse(t)
                spans = [(x, y) for x, y, h in containers(t, nodes) if h - (1 << 63) in set(some)] if some else []
                kinds.append(len({k for _, _, k, _ in nodes}))
                removed.append(n_within(nodes, spans))
                out.append(clean(without(t, spans)) if nodes else t)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kinds, pa.int32()), pa.array(removed, pa.int32()), pa.array(out, pa.string())], names=["host", "page_id", "section_no", "n_kinds", "n_removed", "clean"])

    return told.select("host", "page_id", "section_no", "text", "gone").mapInArrow(convert, "host string, page_id bigint, section_no int, n_kinds int, n_removed int, clean string")
