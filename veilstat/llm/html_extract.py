"""Main text of web pages by wrappers: union-free regular expressions over the token streams of a host's pages.

A page becomes a stream of structural tokens: block-level tags with their class and id, and text. Inline tags are
transparent and end tags that HTML may leave out are dropped, so `<p><b>a<br><p>b</p>` is `<p # <p #`. All pages of a
host take part: those of one skeleton (the stream with adjacent repetitions as repeated groups) become one structure,
skeletons are dealt into templates by their containers (half of them shared, and an article in both or in neither),
and each template's skeletons are aligned one after another with the wrapper so far: equal tags stay, texts become
slots, and any other mismatch an optional group. Each text of the wrapper then gets a role: boilerplate if it lies in a
menu, header, footer, sidebar, notice, advert, form, script, style or comments; boilerplate if every page that has the
slot or group has the same words there, in the article too (seen on LEAST_INVARIANT pages whose texts differ, so copies
of a page count once); content if it lies in the article, where the articles hold at least half of the open text, or
else in the container with most open text. Landmarks decide nothing on a page; they are evidence for the roles.

A page is read against its template's wrapper in one deterministic pass: one token decides on optional and repeated groups, and a tag
that the page does not have at its place is looked for among the next eight tokens, end tags and landmarks in the whole rest. A text that this pass does not meet is content if it lies within the elements around the wrapper's
content, however short it is. Content texts make blocks: character references decoded, white space as one space,
trimmed, joined by line feeds.

Null or empty html: empty text. A host with one page has a wrapper of that page. Repeated rows stay, extra columns
are ignored, an empty table gives an empty result. No part of a page is cut, however long: reading is linear in its
length, and a page is held whole with its tokens. What is left to align of two structures, equal ends apart, is halved in the middle
where its sizes' product is beyond ALIGN_CELLS (two stretches of 1,024 nodes without a repetition): then a match across the halves is missed
and becomes two optional groups.
"""

from __future__ import annotations

import bisect
import difflib
import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.llm._spark import checkpointed, small_batches
from veilstat.llm.url_filter import host_of
from veilstat.sources.tables import table

LEAST_INVARIANT, LEAST_ALIKE = 3, 0.5
BROADCAST_BYTES = 64 << 20
ALIGN_CELLS, HELD_NODES, SALTS, FAN = 1 << 20, 1 << 18, 16, 256

# HTML element names by how they shape text.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
IMPLIED_END = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup html head body".split())
APART = frozenset("head nav footer aside form script style noscript iframe textarea title select button svg canvas template dialog object audio video menu".split())
BLOCKS = frozenset("address blockquote dl figcaption figure h1 h2 h3 h4 h5 h6 ol pre ul".split())
MAIN = frozenset(("article", "main"))
# Class and id names of what is no article: such a word alone, last in the name, or first before a word for a box.
APART_KINDS = (
    r"(?:ad|ads|advert\w*|adsense|adbox|banner|promo|promotion|sponsor\w*|cookies?|consent|notices?|alert|newsletter|subscribe|subscription|signup|login|comments?|disqus|replies|"
    r"side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|popup|modal|skip-?link)"
)
APART_WORDS = re.compile(rf"(?:^| )(?:[a-z]+[-_])*{APART_KINDS}(?:[-_]?(?:box|bar|banner|list|section|area|slot|wrap|wrapper|container|block|unit|form|panel|links?|buttons?|item|inner|thread|count|popup))?[-_]*(?= |$)")
# These are apart outside of the article only; within it, the wrapper decides.
OUTER_WORDS = re.compile(r"(?:^| )(?:[a-z]+[-_])*(?:share|sharing|social|related|recommend\w*|overlay|widgets?|toolbar|pagination|pager|legal|disclaimer)(?:[-_][a-z]+)*[-_]*(?= |$)")
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|article-?body|entry-?content|post-?content|main-?content|story-?body)(?:$|[^a-z])")

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
VALUE = re.compile(r"""[^>=]*+(?:(>)|=\s*+(["'])?)""")
MARK = re.compile(r"""(?i)\b(class|id|role|style|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Token:
    """key: `<name.marks`, `</name` or `#`; role hint: -1 apart, 1 in the main part, 0 neither; text for `#`."""

    __slots__ = ("hint", "key", "text")

    def __init__(self, key: str, hint: int, text: str = ""):
        self.key, self.hint, self.text = key, hint, text


def marks(attributes: str) -> tuple[str, bool]:
    """Class and id names without digits, and whether the element is hidden."""
    if not attributes or attributes.isspace():
        return "", False
    names, hidden = [], False
    for name, value in MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            names += [re.sub(r"[0-9]+", "", v) for v in value.split()]
        elif name == "role":
            names += ["nav"] if value == "navigation" else ["footer"] if value == "contentinfo" else ["sidebar"] if value == "complementary" else []
        else:
            hidden |= name == "hidden" or "display:none" in value.replace(" ", "")
    return " ".join(sorted(set(names))), hidden


class Open:
    """A stack of open elements that closes the topmost of a name, with all above it, in constant time each."""

    def __init__(self):
        self.items: list[tuple[str, object]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, what: object) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        self.items.append((name, what))

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def close(self, name: str):
        """What came with the closed element, or None if none of the name is open."""
        if not self.has(name):
            return None
        what = self.items[self.places[name][-1]][1]
        for _ in range(len(self.items) - self.places[name][-1]):
            self.places[self.items.pop()[0]].pop()
        return what


def tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """The place after the tag whose attributes start at `at`, or -1: quoted values may hold `>`.

    A quotation mark that is never closed is none; it stays in `unclosed`, so the page is searched for it only once.
    """
    while m := VALUE.match(page, at):
        at = m.end()
        if m[1]:
            return at
        if m[2] and m[2] not in unclosed:
            end = page.find(m[2], at)
            if end < 0:
                unclosed.add(m[2])
            else:
                at = end + 1
    return -1


def tokens(page: str) -> list[Token]:
    """The structural token stream of a page; linear in its length."""
    out: list[Token] = []
    stack = Open()  # open elements that change the hint, with the hint before them
    hint, text, at, size, unclosed, loose = 0, [], 0, len(page), set(), False

    def flush() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            if not joined.isspace():
                if out and out[-1].key == "#" and out[-1].hint == hint:
                    out[-1].text += joined
                else:
                    out.append(Token("#", hint, joined))

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if lt + 1 < size and page[lt + 1] in "!?":
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(page, lt)
        end = tag_end(page, m.end(), unclosed) if m and not loose else -1
        if m and end < 0:  # all further `>` are in quoted values: from here on tags end at their first one
            loose, end = True, page.find(">", m.end()) + 1
        if not m or not end:
            text.append("<")
            at = lt + 1
            continue
        at, closing, name, attributes = end, m[1], m[2].lower(), page[m.end() : end - 1]
        if name in RAW and not closing:
            end = re.compile(f"(?i)</{name}").search(page, at)
            gt = page.find(">", end.end()) if end else -1
            at = size if gt < 0 else gt + 1
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                text.append(" ")
            # Inline elements can be apart too (a hidden span, a link of class ad).
            if not closing and name not in VOID and attributes:
                names, hidden = marks(attributes)
                if hidden or (names and apart_names(names, hint)):
                    flush()
                    stack.push(name, hint)
                    hint = -1
                elif stack.has(name):
                    stack.push(name, hint)
            elif not closing and name not in VOID and stack.has(name):
                stack.push(name, hint)
            elif closing and stack.has(name) and stack.items[-1][0] == name:
                flush()
                hint = stack.close(name)
            continue
        flush()
        if closing:
            if stack.has(name):
                hint = stack.close(name)
            if name not in IMPLIED_END:
                out.append(Token(f"</{name}", hint))
            elif out and out[-1].key == "#":
                out.append(Token("|", hint))  # the block ends here, though the wrapper does not ask for it
            continue
        names, hidden = marks(attributes)
        out.append(Token(f"<{name}.{names}" if names else f"<{name}", hint))
        if name in VOID or attributes.endswith("/"):
            continue
        apart = name in APART or hidden or (names and apart_names(names, hint) and not MAIN_WORDS.search(names) and name not in ("body", "html"))
        if name == "header" and hint != 1:
            apart = True
        main = name in MAIN or (names and MAIN_WORDS.search(names))
        if apart:
            out[-1].hint = -1
        if hint >= 0 and (apart or main):
            stack.push(name, hint)
            hint = -1 if apart else 1
        elif stack.has(name):  # the same name inside must close before the element that set the hint
            stack.push(name, hint)
    flush()
    return out


def apart_names(names: str, hint: int) -> bool:
    """Whether class and id names say that an element is no part of the article."""
    return bool(APART_WORDS.search(names) or (hint != 1 and OUTER_WORDS.search(names)))


# A wrapper is a list of nodes: ["t", key], ["r", nodes], ["o", nodes] and texts, ["x", common, role hint, length, pages,
# contents, only, role]: hashes of the texts that every page has there, the texts' length, the pages, at most LEAST_INVARIANT
# hashes of the open text of those pages (so that copies of a page count once), the hash if all texts are the same,
# and in a settled wrapper 1 for content or -1 for boilerplate.


def shape(node: list) -> str:
    kind = node[0]
    return node[1] if kind == "t" else ("#-" if node[2] == -1 else "#") if kind == "x" else kind + "(" + shape(node[1][0]) + ")"


def skeleton(nodes: list[list]) -> str:
    """The whole form of nodes, without what their texts say."""
    return " ".join(shape(n) if n[0] in "tx" else f"{n[0]}({skeleton(n[1])})" for n in nodes)


def text_hash(text: str) -> int:
    return zlib.crc32(" ".join(text.split()).encode())


def structure(stream: list[Token]) -> list[list]:
    """The nodes of one page, adjacent repetitions collapsed."""
    content = zlib.crc32("\n".join(t.text for t in stream if t.key == "#" and t.hint != -1).encode())
    nodes = []
    for t in stream:
        if t.key == "#":
            h = text_hash(t.text) if t.hint != -1 else 0
            nodes.append(["x", [h] if h else [], t.hint, len(t.text), 1, [content] if h else [], h])
        elif t.key != "|":
            nodes.append(["t", t.key])
    return collapse(nodes)


def collapse(nodes: list[list], width: int = 12) -> list[list]:
    """Runs of the same pattern, starting with an opening tag, as one repeated group: patterns of up to `width` nodes one length after another, longer ones by their distance."""
    for w in range(1, width + 1):
        keys = [shape(n) for n in nodes]
        out, i = [], 0
        while i < len(nodes):
            body = keys[i : i + w]
            if keys[i][:1] == "<" and keys[i][1] != "/" and len(body) == w and keys[i + w : i + 2 * w] == body and not all(k.startswith("r(") for k in body):
                group = [json.loads(json.dumps(n)) for n in nodes[i : i + w]]
                i += w
                while keys[i : i + w] == body:
                    group = [merge_node(a, b, True) for a, b in zip(group, nodes[i : i + w], strict=True)]
                    i += w
                out.append(["r", group])
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    while (found := long_repeat([shape(n) for n in nodes], width)) is not None:
        start, w, times = found
        group = [json.loads(json.dumps(n)) for n in nodes[start : start + w]]
        for at in range(start + w, start + w * times, w):
            group = [merge_node(a, b, True) for a, b in zip(group, nodes[at : at + w], strict=True)]
        nodes = [*nodes[:start], ["r", group], *nodes[start + w * times :]]
    return nodes


def long_repeat(keys: list[str], width: int) -> tuple[int, int, int] | None:
    """(start, period, times) of the shortest period beyond `width` at which keys repeat, its leftmost place; None if nothing repeats.

    A period is the distance between an opening tag and its next likeness; around such a pair the stretch that agrees with
    itself one period on is followed both ways, once, and holds a repetition if it is as long as the period. Linear in the keys for each period.
    """
    later: dict[str, int] = {}
    pairs = []
    for i in range(len(keys) - 1, -1, -1):
        if keys[i][:1] == "<" and keys[i][1] != "/":
            if keys[i] in later and later[keys[i]] - i > width:
                pairs.append((later[keys[i]] - i, i))
            later[keys[i]] = i
    seen: dict[int, int] = {}  # of each period, up to where stretches are known
    for w, i in sorted(pairs):
        if i < seen.get(w, 0):
            continue
        lo, hi = i, i
        while lo > seen.get(w, 0) and keys[lo - 1] == keys[lo - 1 + w]:
            lo -= 1
        while hi + w < len(keys) and keys[hi] == keys[hi + w]:
            hi += 1
        seen[w] = hi
        for start in range(lo, hi - w + 1):
            if keys[start][:1] == "<" and keys[start][1] != "/":
                return start, w, 1 + (hi - start) // w
    return None


def merge_node(a: list, b: list, within: bool = False) -> list:
    """One node for two of the same shape, of two sets of pages or within one page."""
    if a[0] == "t":
        return a
    if a[0] == "x":
        common = set(a[1]) | set(b[1]) if within else set(a[1]) & set(b[1])
        contents = sorted({*a[5], *b[5]})[:LEAST_INVARIANT] if common else []
        return ["x", sorted(common), max(a[2], b[2]), a[3] + b[3], max(a[4], b[4]) if within else a[4] + b[4], contents, a[6] if a[6] == b[6] else 0]
    if len(a[1]) == len(b[1]) and skeleton(a[1]) == skeleton(b[1]):
        return [a[0], [merge_node(x, y, within) for x, y in zip(a[1], b[1], strict=True)]]
    return [a[0], align(a[1], b[1])]


def absorb(a: list, b: list) -> list:
    """A repeated node with a further repetition of pages it has already met."""
    if a[0] != "x":
        return a if a[0] == "t" else [a[0], [absorb(x, y) for x, y in zip(a[1], b[1], strict=False)] + a[1][len(b[1]) :]]
    return ["x", a[1], max(a[2], b[2]), a[3] + b[3], a[4], a[5], a[6] if a[6] == b[6] else 0] if b[0] == "x" else a


def matched(a: list[str], b: list[str], i: int = 0, k: int = 0) -> Iterator[tuple[str, int, int, int, int]]:
    """Opcodes of two key lists; equal ends are taken off and what is left too large for one table is halved."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if lead:
        yield "equal", i, i + lead, k, k + lead
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if len(x) * len(y) > ALIGN_CELLS:
        h, m = len(x) // 2, len(y) // 2
        yield from matched(x[:h], y[:m], i + lead, k + lead)
        yield from matched(x[h:], y[m:], i + lead + h, k + lead + m)
    else:
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            yield op, i + lead + i1, i + lead + i2, k + lead + j1, k + lead + j2
    if tail:
        yield "equal", i + len(a) - tail, i + len(a), k + len(b) - tail, k + len(b)


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for what two node lists stand for."""
    keys_a, keys_b = [shape(n).removeprefix("o(").removeprefix("r(").rstrip(")") for n in a], [shape(n).removeprefix("o(").removeprefix("r(").rstrip(")") for n in b]
    out: list[list] = []
    for op, i, j, k, m in matched(keys_a, keys_b):
        if op == "equal":
            out += [merge_kinds(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
            continue
        for run in (a[i:j], b[k:m]):
            if not run:
                continue
            if out and out[-1][0] == "r" and [shape(n) for n in run] == [shape(n) for n in out[-1][1]]:
                out[-1] = ["r", [absorb(x, y) for x, y in zip(out[-1][1], run, strict=True)]]
            else:
                out += [n if n[0] == "o" else ["o", [n]] for n in run] if len(run) == 1 else [["o", run]]
    return out


def merge_kinds(x: list, y: list) -> list:
    """Nodes that begin alike but differ in kind: a group absorbs a single, an optional stays optional."""
    if x[0] == y[0]:
        return merge_node(x, y)
    inner = lambda n: n[1] if n[0] in "ro" else [n]
    joined = align(inner(x), inner(y))
    if "o" in (x[0], y[0]):
        repeated = "r" in (x[0], y[0])
        return ["o", [["r", joined]] if repeated else joined]
    return ["r", joined]


def wrapper_of(pages: list[list[list]]) -> list[list]:
    """Aligns structures one after another and settles the role (1 content, -1 boilerplate) of each text.

    Tags are evidence: texts apart are boilerplate; the article is the content if it holds at least half of the open
    text that differs between pages, else the region with most such text is. Words of every page are boilerplate.
    """
    wrapper = pages[0]
    for page in pages[1:]:
        wrapper = align(wrapper, page)
    for x in texts(wrapper):
        if x[2] == -1 or len(x[5]) < LEAST_INVARIANT:
            x[1], x[5], x[6] = None, [], 0
    marked, other = (sum(x[3] for x in texts(wrapper) if x[2] == hint and not x[6]) for hint in (1, 0))
    leads = marked >= other and any(x[2] == 1 for x in texts(wrapper))
    best = {id(x) for x in texts(wrapper) if x[2] == 1} | title(wrapper) if leads else region(wrapper)
    for x in texts(wrapper):
        x.append(1 if x[2] != -1 and id(x) in best and not x[6] else -1)
    return wrapper


def title(nodes: list[list]) -> set[int]:
    """The text of a first-level heading that differs between pages and is the last open one before the article."""
    found, heading = set(), False
    for n in leaves(nodes):
        if n[0] == "t":
            heading = n[1].split(".")[0] == "<h1" or (heading and n[1][1] != "/")
        elif n[2] == 1:
            return found
        elif n[2] == 0 and not n[6]:
            found = {id(n)} if heading else set()
    return set()


def leaves(nodes: list[list]) -> Iterator[list]:
    """Tags and texts in order."""
    for n in nodes:
        if n[0] in "tx":
            yield n
        else:
            yield from leaves(n[1])


def texts(nodes: list[list]) -> Iterator[list]:
    for n in nodes:
        if n[0] == "x":
            yield n
        elif n[0] != "t":
            yield from texts(n[1])


def region(nodes: list[list]) -> set[int]:
    """Where no article leads: texts of the innermost container that holds at least two thirds of the open slot text."""
    flat: list[list] = []
    whole: list[bool] = []  # whether a page has the node once; a repeated element is a part of the content, not all of it

    def spread(ns, once=True):
        for n in ns:
            if n[0] in "tx":
                flat.append(n)
                whole.append(once)
            else:
                spread(n[1], once and n[0] != "r")

    spread(nodes)
    weigh = lambda x: x[3] if x[2] != -1 and not x[6] else 0.0
    total = sum(weigh(n) for n in flat if n[0] == "x")
    best, best_size, open_at = {id(n) for n in flat if n[0] == "x" and n[2] != -1}, len(flat) + 1, {}
    for i, n in enumerate(flat):
        if n[0] != "t":
            continue
        if n[1].startswith("</"):
            starts = open_at.get(n[1][2:], [])
            if starts:
                start = starts.pop()
                own = [m for m in flat[start:i] if m[0] == "x"]
                if total and whole[start] and n[1][2:] not in BLOCKS and sum(map(weigh, own)) >= total * 2 / 3 and i - start < best_size:
                    best, best_size = {id(m) for m in own if m[2] != -1}, i - start
        else:
            open_at.setdefault(n[1][1:].split(".")[0], []).append(i)
    return best


def first_keys(node: list) -> set[str]:
    """The tokens a node can begin with."""
    if node[0] == "t":
        return {node[1]}
    if node[0] == "x":
        return {shape(node)}
    out: set[str] = set()
    for n in node[1]:
        out |= first_keys(n)
        if n[0] != "o":
            break
    return out


def template_keys(stream: list[Token]) -> frozenset[str]:
    """What tells templates of a host apart: containers outside of menus and the like, and whether there is an article."""
    keys = {t.key for t in stream if t.hint != -1 and t.key[0] == "<" and t.key[1] != "/" and ("." in t.key or t.key[1:] in ("article", "main", "section"))}
    return frozenset(keys | {"article"} if any(t.key == "#" and t.hint == 1 for t in stream) else keys)


def template_of(keys: frozenset[str], leaders: list[frozenset[str]]) -> int | None:
    """The most similar leader, if it shares half of the containers and has an article exactly if the page does."""
    best, at = LEAST_ALIKE, None
    for i, own in enumerate(leaders):
        alike = len(keys & own) / max(len(keys | own), 1) if keys or own else 1.0
        if ("article" in keys) == ("article" in own) and (alike > best or (at is None and alike == best)):
            best, at = alike, i
    return at


def templates(found: list[tuple[frozenset[str], list[list], int]]) -> list[tuple[frozenset[str], list[tuple[list[list], int]]]]:
    """(leader's keys, [(structure, pages)]) of each template, from (keys, structure, pages); the most frequent first."""
    pages: dict[frozenset[str], int] = {}
    for keys, _, n in found:
        pages[keys] = pages.get(keys, 0) + n
    leaders: list[frozenset[str]] = []
    for keys in sorted(pages, key=lambda k: (-pages[k], sorted(k))):
        if template_of(keys, leaders) is None:
            leaders.append(keys)
    own: list[list[tuple[list[list], int]]] = [[] for _ in leaders]
    for keys, nodes, n in sorted(found, key=lambda f: (-f[2], skeleton(f[1]))):
        own[template_of(keys, leaders)].append((nodes, n))
    return list(zip(leaders, own, strict=True))


def inferred(found: list[tuple[frozenset[str], list[list], int]]) -> list[list]:
    """[leader's keys, wrapper] of each template of a host, from (keys, structure, pages) of its distinct skeletons."""
    return [[sorted(keys), wrapper_of([nodes for nodes, _ in group])] for keys, group in templates(found)]


class Path:
    """The open elements around a token, without those whose end tags may be left out; how many of them, from the
    outermost on, are those of `core`, and how few were open since `low` was last set."""

    def __init__(self, core: list[str] | None = None):
        self.elements, self.core, self.shared, self.low = Open(), core or [], 0, 0

    def step(self, key: str) -> None:
        if key[0] != "<":
            return
        name, depth = key.strip("</").split(".")[0], len(self.elements.items)
        if key[1] == "/":
            self.elements.close(name)
            self.shared, self.low = min(self.shared, len(self.elements.items)), min(self.low, len(self.elements.items))
        elif name not in IMPLIED_END and name not in VOID:
            self.elements.push(name, key)
            if self.shared == depth < len(self.core) and key == self.core[depth]:
                self.shared += 1


class Reader:
    """A wrapper ready to read pages."""

    def __init__(self, wrapper: list[list]):
        self.nodes = self.prepared(wrapper)
        self.core: list[str] | None = None  # the innermost elements around all content
        path = Path()

        def spread(nodes: list[list]) -> None:
            for n in nodes:
                if n[0] == "t":
                    path.step(n[1])
                elif n[0] != "x":
                    spread(n[1])
                elif n[7] == 1:
                    if self.core is None:
                        self.core = [key for _, key in path.elements.items]
                    else:
                        del self.core[path.low :]
                    path.low = len(path.elements.items)

        spread(wrapper)

    def prepared(self, nodes: list[list]) -> list[tuple]:
        return [("t", n[1]) if n[0] == "t" else ("x", shape(n), n[7], frozenset(n[1] or ())) if n[0] == "x" else (n[0], self.prepared(n[1]), first_keys(n)) for n in nodes]

    def roles(self, stream: list[Token]) -> list[int]:
        """The role of each text: the wrapper's; where it does not know a text, by whether that lies around its content."""
        keys = [t.key if t.key != "#" else "#-" if t.hint == -1 else "#" for t in stream]
        places: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            places.setdefault(k, []).append(i)
        out: list[int] = [0] * len(keys)

        def walk(nodes: list[tuple], i: int) -> int:
            for n in nodes:
                while i < len(keys) and keys[i] == "|":
                    i += 1
                if i >= len(keys):
                    return i
                if n[0] == "t":
                    if keys[i] == n[1]:
                        i += 1
                        continue
                    found = places.get(n[1], [])
                    at = bisect.bisect_left(found, i)
                    # An end tag or a landmark further on: the page has something more here; else it lacks this tag.
                    if at < len(found) and (found[at] - i <= 8 or n[1].startswith(("</", "<article", "<main"))):
                        i = found[at] + 1
                elif n[0] == "x":
                    if keys[i] == n[1]:
                        out[i] = -1 if n[3] and text_hash(stream[i].text) in n[3] else n[2]
                        i += 1
                elif n[0] == "o":
                    if keys[i] in n[2]:
                        i = walk(n[1], i)
                else:
                    while i < len(keys) and keys[i] in n[2]:
                        after = walk(n[1], i)
                        if after == i:
                            break
                        i = after
                        while i < len(keys) and keys[i] == "|":
                            i += 1
            return i

        walk(self.nodes, 0)
        path = Path(self.core)
        for i, t in enumerate(stream):
            if t.key != "#":
                path.step(t.key)
            elif not out[i]:
                out[i] = 1 if t.hint != -1 and self.core is not None and path.shared == len(self.core) else -1
        return out


class Host:
    """The readers of a host's templates."""

    def __init__(self, templates: list[list]):
        self.leaders, self.wrappers = [frozenset(k) for k, _ in templates], [w for _, w in templates]
        self.readers: dict[int, Reader] = {}

    def roles(self, stream: list[Token]) -> list[int]:
        at = template_of(template_keys(stream), self.leaders)
        if at not in self.readers:
            self.readers[at] = Reader(self.wrappers[at])
        return self.readers[at].roles(stream)


def main_text(page: str, reader: Host | None) -> str:
    """The content blocks of a page; without a host's wrappers, by the wrapper of the page itself."""
    stream = tokens(page)
    if not stream:
        return ""
    roles = (reader or Reader(wrapper_of([structure(stream)]))).roles(stream)
    blocks: list[str] = []
    open_block = False
    for t, role in zip(stream, roles, strict=True):
        if t.key != "#":
            open_block = False
            continue
        if role != 1:
            continue
        text = " ".join(entities.unescape(t.text).split())
        if not text:
            continue
        if open_block and blocks:
            blocks[-1] += " " + text
        else:
            blocks.append(text)
        open_block = True
    return "\n".join(blocks)


_readers: dict[str, Host] = {}


def reader_of(wrapper: str | None) -> Host | None:
    if wrapper is None:
        return None
    if wrapper not in _readers:
        if len(_readers) >= 512:
            _readers.clear()
        _readers[wrapper] = Host(json.loads(wrapper))
    return _readers[wrapper]


class Skeletons:
    """Pages of the same host and skeleton as one structure."""

    def __init__(self):
        self.found: dict[tuple[str, int], list] = {}
        self.nodes = 0

    def add(self, host: str, skel: int, keys: list[str], nodes: list[list], pages: int) -> None:
        own = self.found.get((host, skel))
        if own:
            own[1], own[2] = [merge_node(x, y) for x, y in zip(own[1], nodes, strict=True)], own[2] + pages
        else:
            self.found[host, skel] = [keys, nodes, pages]
            self.nodes += len(nodes)

    def batch(self) -> pa.RecordBatch:
        rows = [(host, skel, json.dumps(own, separators=(",", ":"))) for (host, skel), own in self.found.items()]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["host", "skel", "page"])


def skeleton_id(nodes: list[list]) -> int:
    return int.from_bytes(hashlib.blake2b(skeleton(nodes).encode(), digest_size=8).digest(), "big", signed=True)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host, from all of its pages.

    Pages of one skeleton become one structure, first where they are read, then in SALTS parts a host. While a host has
    more than FAN distinct skeletons, groups of about FAN are aligned into one structure a template; the last task of
    a host aligns what is left of them.
    """
    found = "host string, skel long, page string"

    def skeletons(batches):
        own = Skeletons()
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = tokens(html.as_py() or "")
                if stream:
                    nodes = structure(stream)
                    own.add(host, skeleton_id(nodes), sorted(template_keys(stream)), nodes, 1)
                    if own.nodes > HELD_NODES:
                        yield own.batch()
        yield own.batch()

    def folded(key: tuple, rows: pa.Table) -> pa.Table:
        own = Skeletons()
        for host, skel, page in zip(*(rows[c].to_pylist() for c in ("host", "skel", "page")), strict=True):
            own.add(host, skel, *json.loads(page))
        return pa.Table.from_batches([own.batch()])

    def aligned(key: tuple, rows: pa.Table) -> pa.Table:
        out = Skeletons()
        for keys, group in templates([(frozenset(k), nodes, n) for k, nodes, n in map(json.loads, rows["page"].to_pylist())]):
            nodes = group[0][0]
            for other, _ in group[1:]:
                nodes = align(nodes, other)
            out.add(key[0].as_py(), skeleton_id(nodes), sorted(keys), nodes, sum(n for _, n in group))
        return pa.Table.from_batches([out.batch()])

    def infer(key: tuple, rows: pa.Table) -> pa.Table:
        own = [(frozenset(k), nodes, n) for k, nodes, n in map(json.loads, rows["page"].to_pylist())]
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": [json.dumps(inferred(own), separators=(",", ":"))]})

    made = pages.select(host_of(F.col("url")).alias("host"), "html").filter(F.col("host").isNotNull()).mapInArrow(skeletons, found)
    parts = checkpointed(made.withColumn("salt", F.pmod("skel", F.lit(SALTS))).groupBy("host", "salt").applyInArrow(folded, found))
    held = None
    while True:
        sizes = parts.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (sizes[0] or 0) <= FAN or sizes[1] == held:
            break  # few, or as many as before: no two of them are of one template
        held = sizes[1]
        groups = parts.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups"))
        parts = checkpointed(parts.join(groups, "host").withColumn("salt", F.pmod(F.xxhash64("skel"), "groups")).groupBy("host", "salt").applyInArrow(aligned, found))
    return parts.groupBy("host").applyInArrow(infer, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    found = checkpointed(wrappers(pages))
    size = found.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0
    # Broadcast under a checked size; beyond it, an equi-join on the host, whose large partitions Spark splits.
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(side, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        for batch in batches:
            out = [main_text(h.as_py() or "", reader_of(w.as_py())) for h, w in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(table(spark, sf_dir, "pages"))
