"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. The first pass judges a block by itself: by the elements it
stands in, its link density, its length and its density of stop words. What is short or in doubt stays open.
In the second pass open blocks take the label of the nearest blocks that are decided.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskspark.llm.common import extended, slices

#: A block with more of its characters in links is no main text; so is a short block with any.
MOST_LINKS = 0.5
#: Characters up to which a block is short, and from which one without many links is main text in any language.
SHORT, LONG = 70, 200
#: Share of stop words from which a block reads like prose, and from which it surely does.
SOME_STOPS, MANY_STOPS = 0.15, 0.3

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that was for on with as at by it be this are from or an not have but they you he she we "
    "der die das und in den von zu mit ist des im nicht ein eine als auch es an auf für sich dem er sie wir war "
    "le la les de des et un une du en que est pour qui dans sur pas plus par au il ce avec ne se sont "
    "el los las y que del una con no para es lo al por su como más pero sus o este ha sin sobre".split()
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())
#: Elements that are looked at only if they have attributes.
_PLAIN = _INLINE | {"p", "li"}
#: Elements whose content is never main text.
_DROPPED = frozenset(
    "head nav footer aside form button select textarea input fieldset menu menuitem dialog noscript template iframe object "
    "applet audio video canvas svg map datalist".split())
#: Elements whose content is not markup; it ends with their end tag.
_RAW = frozenset("script style xmp textarea title noembed noframes iframe plaintext".split())
#: Words of class, id or role that mark what is around the main text.
_AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar topnav sidenav subnav navigation skip breadcrumb breadcrumbs footer masthead topbar cookie cookies consent notice notices gdpr newsletter "
    "subscribe subscription signup share sharing social comment comments reply replies disqus discussion responses related "
    "recommended recommendations widget popup modal overlay login search pagination pager copyright toolbar "
    "disclaimer legal contentinfo complementary dialog alertdialog alert".split())
#: A class or id with one of these tells of a page's layout or state, not of what the element is.
_MODIFIERS = frozenset("has no with without open opened closed enabled disabled collapsed expanded layout".split())
#: Words whose elements stay around the text however much they hold.
_TALK = frozenset("comment comments reply replies disqus discussion responses".split())
#: Words that also name what an article is about: in one, they mark only what is short or mostly links.
_SUBJECTS = frozenset("menu navigation social legal search login promotion subscription sharing copyright alert related".split())
_WRAPPERS = frozenset("wrapper wrap container page layout site".split())
_HEADERS = frozenset(["header"])
_LANDMARK, _OF_LANDMARK = frozenset("article entry post story main".split()), frozenset("content body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/><]*+)(?:(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<torn>[^>]*+)>)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Mark:
    """An element that reads as around the main text, within the mark ``outer`` (0: none).

    ``subject``: only words in _SUBJECTS say so, and it stands in a landmark.
    """

    outer: int
    sure: bool
    wraps: bool
    subject: bool = False
    own: int = 0
    prose: int = 0
    size: int = 0
    linked: int = 0


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    linked: int
    around: bool
    landmark: str
    region: int
    heading: bool


def _marks(rest: str) -> tuple[set[str], set[str], dict[str, str]]:
    """Words of class, id and role; those of them that are no modifiers' company; all attributes."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest.strip() else {}
    words, telling = set(), set()
    for name in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        own = {w.lower() for w in _NAME_WORD.findall(name)}
        words |= own
        if not own & _MODIFIERS:
            telling |= own
    return words, telling, found


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order. Unclosed, crossed and stray tags are taken as browsers mostly do."""
    blocks: list[Block] = []
    runs: list[str] = []
    linked = 0
    marks = [Mark(0, False, False)]
    held: list[int] = []  # the mark of each block
    regions = 0
    # Open elements: name, innermost mark, landmark and the number of it, whether in a link, whether in a heading.
    stack: list[tuple[str, int, str, int, bool, bool]] = [("", 0, "", 0, False, False)]
    open_names: dict[str, int] = {}

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(runs).split())
        if text:
            blocks.append(Block(text, linked, False, stack[-1][2], stack[-1][3], stack[-1][5]))
            held.append(stack[-1][1])
        runs.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        runs.append(text)
        if stack[-1][4]:
            linked += len(text.strip())

    def pop_to(name: str) -> None:
        while len(stack) > 1:
            popped = stack.pop()[0]
            open_names[popped] -= 1
            if popped == name:
                return

    at, size, last = 0, len(page), page.rfind(">") + 1
    while at < size:
        tag = _TOKEN.search(page, at) if at < last else None
        if tag is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!]", rest)  # a tag that the page's end cuts off
            add(rest[: cut.start()] if cut else rest)
            break
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        if tag["name"] is None:
            continue
        name, inside = tag["name"].lower(), tag["rest"] if tag["rest"] is not None else tag["torn"]
        if name not in _INLINE:
            close()
        if tag["end"]:
            if open_names.get(name):
                pop_to(name)
            continue
        if name in _RAW:
            ending = re.compile(rf"</{re.escape(name)}[\s/>]|\Z", re.I).search(page, at)
            at = ending.start()
            if not ending[0]:
                break
            at = page.find(">", at) + 1 or size
            continue
        if name in _VOID:
            continue
        if name in ("p", "li", "a", "option", "dd", "dt", "tr", "td", "th") and stack[-1][0] == name:
            pop_to(name)
        _, mark, landmark, region, link, heading = stack[-1]
        if (name not in _PLAIN or "=" in inside) and name not in ("html", "body"):
            words, telling, found = _marks(inside)
            role = set(found.get("role", "").lower().split())
            sure = name in _DROPPED and name != "form" or bool(role & _AROUND)
            sure = sure or bool(telling & _TALK) and not (name in ("article", "main") and words & _LANDMARK)
            sure = sure or "aria-hidden" in found and found["aria-hidden"] == "true"
            sure = sure or bool(re.search(r"\shidden(\s|$|=)", inside)) or "display:none" in found.get(
                "style", "").replace(" ", "").lower()
            header = (name == "header" or bool(telling & _HEADERS)) and not landmark and not words & (_LANDMARK - {"main"})
            sure = sure or header and name == "header"
            marked = sure or header or name == "form" or bool(telling & _AROUND)
            lands = _is_landmark(name, words, found)
            if mark:
                marks[mark].wraps |= marked or lands or name == "h1"
            if marked:
                wraps = name == "form" or lands or bool(words & _WRAPPERS and not sure)
                subject = bool(landmark) and not (sure or header or name == "form") and telling & _AROUND <= _SUBJECTS
                marks.append(Mark(mark, sure, wraps, subject))
                mark = len(marks) - 1
            if lands:
                inner = "article" if name != "main" and "main" not in words or landmark == "article" else "main"
                if inner != landmark:
                    regions += 1
                    landmark, region = inner, regions
        link = link or name == "a" and "href" in inside.lower()
        heading = heading or len(name) == 2 and name[0] == "h" and name[1] in "123456"
        stack.append((name, mark, landmark, region, link, heading))
        open_names[name] = open_names.get(name, 0) + 1
    close()
    _lift(blocks, held, marks)
    return blocks


def _lift(blocks: list[Block], held: list[int], marks: list[Mark]) -> None:
    """Tell which blocks are around the text, passing over marks on what wraps the text itself.

    A mark that is not sure is passed over if its element holds more than half of the prose, if nearly none stands
    outside of marks, and if the element reads as a wrapper: an article or form, or with a landmark, a main heading
    or further marks in it. A mark by a word that may be the article's subject is passed over unless its
    element is short or mostly links.
    """
    for block, mark in zip(blocks, held):
        marks[mark].own += len(block.text) - block.linked
        marks[mark].size += len(block.text)
        marks[mark].linked += block.linked
    for mark in marks[1:]:
        mark.sure = mark.sure or marks[mark.outer].sure
        mark.prose = 0 if mark.sure else mark.own
    for i in range(len(marks) - 1, 0, -1):
        marks[marks[i].outer].prose += marks[i].prose
        marks[marks[i].outer].size += marks[i].size
        marks[marks[i].outer].linked += marks[i].linked
        marks[marks[i].outer].wraps |= marks[i].wraps and not marks[i].sure
    total, outside = marks[0].prose + marks[0].own, marks[0].own
    told = any(not m and b.landmark == "article" and not b.heading for b, m in zip(blocks, held))
    around = [False] * len(marks)
    for i, mark in enumerate(marks[1:], 1):
        inner = around[mark.outer]
        lifted = not (inner or mark.sure or told) and mark.wraps and 2 * mark.prose > total and 10 * outside <= mark.prose
        about = mark.subject and not mark.sure and mark.size > SHORT and mark.linked <= MOST_LINKS * mark.size
        around[i] = inner or not (lifted or about)
        if lifted:
            outside += mark.own
            told = any(m == i and b.landmark == "article" and not b.heading for b, m in zip(blocks, held))
    for block, mark in zip(blocks, held):
        block.around = around[mark]


def _is_landmark(name: str, words: set[str], found: dict[str, str]) -> bool:
    return name in ("article", "main") or "main" in words and found.get("role", "").lower() == "main" or found.get(
        "itemprop", "").lower() == "articlebody" or bool(words & _LANDMARK and words & _OF_LANDMARK)


def _holder(blocks: list[Block]) -> str:
    """The kind of landmark that holds the text, if any: articles, unless main itself holds more than each of them.

    Articles in or beside a main with more prose of its own are teasers of other pages.
    """
    prose: dict[str, dict[int, int]] = {}
    for block in blocks:
        if not block.around and block.landmark:
            held = prose.setdefault(block.landmark, {})
            held[block.region] = held.get(block.region, 0) + (0 if block.heading else len(block.text) - block.linked)
    if "main" in prose and sum(prose["main"].values()) > max(prose.get("article", {0: 0}).values()):
        return "main"
    return next((kind for kind in ("article", "main") if kind in prose), "")


def labels_of(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    within = _holder(blocks)
    labels: list[bool | None] = []
    prose: list[bool] = []
    for block in blocks:
        density = block.linked / len(block.text)
        words = _WORD.findall(block.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        prose.append(stops >= SOME_STOPS or block.heading)
        if block.around or within and block.landmark != within:
            labels.append(False)
        elif density > MOST_LINKS and not (within and stops >= MANY_STOPS):
            labels.append(False)
        elif within and len(block.text) > SHORT:
            labels.append(True)  # the page itself says where its article is
        elif len(block.text) <= SHORT:
            labels.append(False if density > 0 and not within else None)
        elif stops >= MANY_STOPS or len(block.text) > LONG:
            labels.append(True)
        else:
            labels.append(None)
    # What elements or classes mark as around the text says nothing about its neighbours, nor do blocks
    # outside of the article if there is one.
    chosen = [i for i, b in enumerate(blocks) if not b.around and (not within or b.landmark == within)]
    for i, label in zip(chosen, _inherited([labels[i] for i in chosen], [bool(within) or prose[i] for i in chosen])):
        labels[i] = label
    return [bool(x) for x in labels]


def _inherited(labels: list[bool | None], hopeful: list[bool]) -> list[bool]:
    """Fill what is open from the nearest decided blocks; where they disagree, the nearer one tells.

    With both equally near, or none at all, a block that reads like prose is main text.
    """
    size = len(labels)
    before, after = [-1] * size, [size] * size
    for i in range(size):
        before[i] = i if labels[i] is not None else before[i - 1] if i else -1
    for i in reversed(range(size)):
        after[i] = i if labels[i] is not None else after[i + 1] if i + 1 < size else size
    if all(x is None for x in labels):
        return [True] * size
    out = []
    for i, label in enumerate(labels):
        if label is None:
            left = labels[before[i]] if before[i] >= 0 else None
            right = labels[after[i]] if after[i] < size else None
            if left is None or right is None or left == right:
                label = right if left is None else left
            elif i - before[i] == after[i] - i:
                label = hopeful[i]
            else:
                label = left if i - before[i] < after[i] - i else right
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks, white space being single spaces, joined by single spaces.

    Null, empty and textless pages give an empty text.
    """
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b.text for b, good in zip(blocks, labels_of(blocks)) if good)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add ``text`` (the page's main text) and ``n_chars`` (its code points); such columns are replaced.

    Whole pages of any length are read; rows, null or repeated, stay one for one.
    """
    schema = extended(pages, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()))
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = [main_text(page) for page in batch.column(column).to_pylist()]
            columns = [*(batch.column(c) for c in kept), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
