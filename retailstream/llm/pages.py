"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. In the first pass the share of
stop words, the length and the share of linked text decide a block, as do the
elements that it stands in: menus, footers, sidebars, forms, adverts, notices and
comments are never text. Short blocks and others that say little stay open; in
the second pass they take the label of the nearest decided neighbour, inside the
article if the page marks one. Stop words are those that stand in many pages of
the table, so that no list per language is needed. On a page that has hardly any of
them, in a language that few pages or no blanks are written in, length and links decide.
"""

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = 300  # in the list at most
STOP_SHARE = 0.01  # of the pages that a stop word stands in at least
STOP_LENGTH = 6  # letters of a stop word at most
SHORT = 70  # characters
STOP_GOOD, STOP_BAD = 0.2, 0.05  # share of stop words
LINKED = 0.5  # share of linked characters of a menu
_FLUSH = 200_000

# An end tag or start tag with its attributes, a comment, or a declaration; each
# may be cut off by the end of the page.
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")

# Elements by what they mean for the text.
_RAW = frozenset("script style textarea title noscript template iframe object svg math canvas audio video xmp noembed noframes select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption button label".split()
)
_NEVER = frozenset("nav footer aside form menu dialog search button fieldset head".split())
_MAIN = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NEVER_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav aside menu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments disqus reply replies footer header "
    "masthead pagination pager widget toolbar skip copyright legal disclaimer".split()
)
_TEXT_NAMED = frozenset("article post entry content story main body title headline".split())
# Before or after a name they say what the element has, is in or lacks, not what it is.
_MODIFIERS = frozenset("with without no not non has have is hide hidden show".split())


_COMMENTS = frozenset("comment comments disqus reply replies".split())
# After a name they say what the element is instead, if it holds most of the page's text.
_LAYOUTS = frozenset("layout news story stories article content main wrapper container grid columns template view".split())
# After the name of comments: of an element that can be commented on.
_COMMENTED = frozenset("open opened closed enabled disabled on off count allowed".split())
# Scripts that write a word with fewer signs, or without blanks between words.
_DENSE = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF\U00020000-\U0003FFFF]")
DENSITY = 3  # letters that one such sign stands for

FREE, LAYOUT, NAMED, CERTAIN = 0, 1, 2, 3


def _named(value: str) -> int:
    """What a class or id says of its element: NAMED if it is never text ("with-sidebar" does
    not say so), LAYOUT if it might be a name of the layout, CERTAIN if it holds comments."""
    found = FREE
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        for i, word in enumerate(words):
            if word not in _NEVER_NAMED or _MODIFIERS & set(words[:i]):
                continue
            if word in _COMMENTS:
                if not _COMMENTED & set(words[i + 1 :]):
                    return CERTAIN
            else:
                found = max(found, LAYOUT if i + 1 < len(words) and words[-1] in _LAYOUTS else NAMED)
    return found


class _Block:
    __slots__ = ("text", "linked", "never", "main", "named")

    def __init__(self, text, linked, never, main, named):
        self.text, self.linked, self.never, self.main, self.named = text, linked, never, main, named


class _Named:
    """An element that its class or id rules out; `outer` is the next such element around it."""

    __slots__ = ("outer", "kind", "inside_main", "holds_main", "letters")

    def __init__(self, outer, kind, inside_main):
        self.outer, self.kind, self.inside_main, self.holds_main, self.letters = outer, kind, inside_main, False, 0


def _is_never(tag: str, attributes: str, inside_main: bool) -> int:
    """FREE if the element can be text, LAYOUT or NAMED if just its class or id says it can't, else CERTAIN."""
    if tag in _NEVER or tag == "header" and not inside_main:
        return CERTAIN
    if tag in ("body", "html") or not attributes:
        return FREE
    never = FREE
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            kind = _named(value)
            if kind == CERTAIN or kind and tag not in _MAIN and not (words <= {"header", *_TEXT_NAMED, ""} and words & _TEXT_NAMED):
                never = max(never, kind)
        elif name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
            return CERTAIN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return CERTAIN
        elif name == "hidden" and value != "until-found":
            return CERTAIN
    return never


def _parsed(page: str) -> tuple[list[_Block], list[_Named]]:
    """Blocks of text in page order, with characters inside links and what they stand in."""
    # Tag, and whether it or what is around it is never text, is an article or main, and the innermost named element.
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, -1)]
    open_tags, out, named = Counter(), [], []
    parts, linked, in_link = [], 0, False
    at, size = 0, len(page)

    def ended():
        nonlocal parts, linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(_Block(text, linked, *stack[-1][1:]))
        parts, linked = [], 0

    def add(raw):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(_SPACE.sub(" ", text).strip())

    def close():
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    while at < size:
        found = _TAG.search(page, at)
        add(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in _RAW:
            if not found[1] and not found[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not found[1]
            continue
        block = tag in _BLOCKS
        if block:
            ended()
            in_link = False
        if found[1]:
            if open_tags[tag]:
                while close() != tag:
                    pass
        elif tag not in _VOID:
            # Starts that end an open paragraph or item of the same kind.
            while len(stack) > 1 and block and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close()
            _, certain, main, inner = stack[-1]
            never = _is_never(tag, found[3], main)
            if not block and not never:
                continue
            if never in (LAYOUT, NAMED):
                named.append(_Named(inner, never, main))
                inner = len(named) - 1
            elif tag in _MAIN and inner >= 0:
                named[inner].holds_main = True
            stack.append((tag, certain or never == CERTAIN, main or tag in _MAIN, inner))
            open_tags[tag] += 1
    ended()
    return out, named


def blocks(page: str) -> list[_Block]:
    """Blocks of text; what `never` is text is so by elements, attributes or names around it.

    A name of the layout rules nothing out if its element holds most of the text. Where
    every article stands in an element with such a name, nor does that.
    """
    found, named = _parsed(page)
    total = 0
    for b in found:
        if not b.never:
            own = len(b.text) - b.linked
            total += own
            if b.named >= 0:
                named[b.named].letters += own
    for e in reversed(named):  # inner ones come after those around them
        if e.outer >= 0:
            named[e.outer].letters += e.letters
            named[e.outer].holds_main |= e.holds_main
    ruled, ruled_inside = [], []
    for e in named:
        own = not (e.kind == LAYOUT and 2 * e.letters > total)
        ruled.append(own or e.outer >= 0 and ruled[e.outer])
        ruled_inside.append(own and (e.inside_main or not e.holds_main) or e.outer >= 0 and ruled_inside[e.outer])
    if not any(b.main and not b.never and not (b.named >= 0 and ruled[b.named]) for b in found):
        ruled = [inside if e.inside_main or e.holds_main else own for e, own, inside in zip(named, ruled, ruled_inside, strict=True)]
    for b in found:
        b.never = b.never or b.named >= 0 and ruled[b.named]
    return found


GOOD, OPEN, BAD = 1, 0, -1


def _length(text: str) -> int:
    return len(text) + (DENSITY - 1) * len(_DENSE.findall(text))


def stop_shares(found: list[_Block], stop_words: frozenset) -> tuple[list[float], bool]:
    """The share of stop words in each block, and whether the list knows the page's language."""
    counts = []
    for block in found:
        words = _WORDS.findall(block.text.lower())
        counts.append((sum(w in stop_words for w in words), len(words)))
    own = [(n, of) for (n, of), b in zip(counts, found, strict=True) if not b.never and b.linked <= LINKED * len(b.text)]
    known = sum(n for n, _ in own) >= STOP_BAD * sum(of for _, of in own)
    return [n / max(1, of) for n, of in counts], known


def first_pass(block: _Block, share: float, known: bool) -> int:
    """By stop words; in a language that the list does not know, by length and links alone."""
    if block.never or block.linked > LINKED * len(block.text):
        return BAD
    if _length(block.text) < SHORT:
        return OPEN
    if not known:
        return GOOD
    if share >= STOP_GOOD:
        return GOOD
    return BAD if share < STOP_BAD and not block.main else OPEN


def second_pass(found: list[_Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided one, the earlier of two at
    the same distance only if both agree; else, inside the article, they are text."""
    out = list(labels)
    for inside in (True, False):
        own = [i for i, b in enumerate(found) if b.main == inside]
        # Inside an article, menus and the like say nothing about the text around them.
        decided = [i for i in own if labels[i] == GOOD or labels[i] == BAD and not inside]
        left, right = {}, {}
        for order, nearest in ((own, left), (own[::-1], right)):
            last, known = None, set(decided)
            for i in order:
                last = i if i in known else last
                nearest[i] = last
        for i in own:
            if labels[i] != OPEN:
                continue
            near = [(abs(j - i), labels[j]) for j in (left[i], right[i]) if j is not None]
            if not near:
                out[i] = GOOD if inside else BAD
            elif len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
                out[i] = GOOD if inside else BAD
            else:
                out[i] = min(near)[1]
    return out


def main_text(page: str | None, stop_words: frozenset) -> str:
    found = blocks(page or "")
    shares, known = stop_shares(found, stop_words)
    labels = second_pass(found, [first_pass(b, share, known) for b, share in zip(found, shares, strict=True)])
    return "\n".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def learn_stop_words(pages: DataFrame, page: str = "html", most: int = STOP_WORDS, share: float = STOP_SHARE) -> frozenset:
    """Short words by the number of pages they stand in, over all pages."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            for content in batch["h"]:
                seen.update({w for w in _WORDS.findall(_TAG.sub(" ", content).lower()) if len(w) <= STOP_LENGTH})
                if len(seen) > _FLUSH:
                    yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})
                    seen = Counter()
        yield pd.DataFrame({"w": list(seen), "n": list(seen.values())}).astype({"w": str, "n": "int64"})

    known = pages.filter(F.col(page).isNotNull()).select(F.col(page).alias("h"))
    total = known.count()
    rows = (
        known.mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= share * total).orderBy(F.desc("n"), "w").limit(most).collect()
    )
    return frozenset(r["w"] for r in rows)


def extracted(stop_words: frozenset, page: Column) -> Column:
    """The main text of a page, empty if there is none."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, stop_words) for x in content], dtype=object)

    return run(page)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    NULL and empty pages have an empty text. Repeated rows stay rows; keys and urls
    are passed on as they are; other columns are left out; an empty table gives an
    empty result. Pages that end amid a tag, a comment or a script are read up to it.
    """
    stop_words = learn_stop_words(pages, page)
    return pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), extracted(stop_words, F.col(page)).alias("text"),
    ).withColumn("n_chars", F.length("text").cast("long"))
