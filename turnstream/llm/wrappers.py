"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tokens: opened block-level tags with their class, and text slots (inline tags and text
within a block make one slot). Two expressions are aligned token by token. Text that both have is fixed and
meets only itself; any other texts at one path that meet become an open slot. Equal neighbouring groups fold
into a repeated group, what repeats on one side repeats in the result, and what only one side has becomes
optional, so aligning all streams of a host one after another leaves one expression that matches each of
them. Streams are first merged by host and shape, then aligned in blocks of ``BLOCK`` shapes, and the results
again, so no task holds all of a host.

The expression divides a host's text: what it holds as fixed text of several pages that differ elsewhere is
the template's, open slots are the pages' own. A page's article is its own text, but for places that HTML
itself marks as something else (nav, footer, forms), link lists (of each slot the characters inside links are
summed over the host), and, where the tags leave it open, classes with telling names. Text in main parts
(article, main) is the article's though it be fixed, as one article may be on several pages.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from math import isqrt
from operator import eq

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, remove

BLOCK = 64
STEP = "\x1f"  # between the names of a path; white space to split(), so in no name
FOLD = 40  # longest group of tokens that is looked for as a repeat; longer ones stay as they are
CELLS = 1_000_000  # of an alignment's table, as bits, that are held at once; of larger tables the rows of its root
FIXED_PAGES = 3  # pages from which on equal text is the template's

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![\w-])""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# The tags of HTML by what they do to text.
RAW = "script style noscript template textarea iframe svg math title select object".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()
OUTSIDE = "head nav footer aside form button menu dialog".split()
MAIN = "article main".split()
OUTSIDE_WORDS = "ad ads adv advert adverts advertisement sponsor sponsored promo nav navbar navigation menu sidebar footer masthead cookie cookies consent notice notices banner alert comment comments respond replies reply disqus share sharing social related recommended breadcrumb breadcrumbs popup modal overlay subscribe subscription newsletter signup login search toolbar widget widgets pagination pager copyright hidden".split()
MAIN_WORDS = "article articlebody post postbody entry story".split()
INLINE_OUTSIDE = "hidden ad ads advert adverts advertisement sponsor sponsored promo".split()
TEXT_TAGS = "p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption".split()
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
_INLINE, _VOID, _CLOSES_P = set(INLINE), set(VOID), set(CLOSES_P)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _name(tag: str, attributes: str) -> str:
    """A block's name: its tag, and its class, id and role, and ``hidden`` if it is not shown."""
    words = set()
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "style" and _UNSEEN.search(value)):
            words.add("hidden")
        elif key != "style":
            words.update(value.split())
    return ".".join([tag, *sorted(words)])


def _tells_outside(name: str, whole: bool = False) -> bool:
    """Whether a class says that a block is no article: a word of it does, and its last word is no article's.

    With ``whole`` the class must be such a word by itself: share, but not share-price.
    """
    for word in name.split(".")[1:]:
        parts = _WORDS.findall(word)
        if whole and len(parts) != 1:
            continue
        if parts and parts[-1] not in MAIN_WORDS and any(w in OUTSIDE_WORDS for w in parts):
            return True
    return False


def _unseen_inline(name: str) -> bool:
    """Whether words within a sentence are no part of it: hidden ones and adverts. Other classes tell nothing of them."""
    return any(word in INLINE_OUTSIDE for word in name.split(".")[1:])


def page_tokens(source: str) -> Iterator[tuple[str, tuple[str, ...], str, int]]:
    """(kind, path, text, characters in links): kind '+' for an opened block, '#' for a text slot.

    path: the names of the open blocks. Text is decoded, its white space single spaces; empty text is no slot.
    Text of inline tags that are hidden or named as adverts and the like is left out.
    """
    path: list[tuple[str, str]] = []
    pieces: list[str] = []
    skipped: list[str] = []  # the inline tag that is left out, and those of its kind within it
    in_link = links = 0
    at, n = 0, len(source)

    def slot():
        text = " ".join(html.unescape("\x00".join(pieces)).replace("\x00", "").split())
        pieces.clear()
        return text

    def names() -> tuple[str, ...]:
        return tuple(p[1] for p in path)

    while at < n:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else n
        if stop > at and not skipped:
            text = source[at:stop]
            pieces.append(text)
            if in_link:
                links += len(text)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if skipped:
                if tag == skipped[0] and not closing:
                    skipped.append(tag)
                elif tag == skipped[0]:
                    skipped.pop()
                continue
            if attributes and not closing and tag not in _VOID and _unseen_inline(_name(tag, attributes)):
                skipped.append(tag)
                continue
            if tag == "a":
                in_link = not closing
            if tag == "br":
                pieces.append(" ")
            continue
        skipped.clear()
        if tag in _RAW_END and not closing:
            end = _RAW_END[tag].search(source, at)
            at = end.start() if end else n
            continue
        if tag in _RAW_END:
            continue
        text = slot()
        if text:
            yield "#", names(), text, links
        links = 0
        in_link = False
        if closing:
            open_at = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] == tag), None)
            if open_at is not None:
                del path[open_at:]
            continue
        ends = SELF_CLOSING.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
        if path and path[-1][0] in ends:
            path.pop()
        elif tag in ("tr",) and len(path) > 1 and path[-2][0] == "tr":
            del path[-2:]
        if tag in _VOID or attributes.rstrip().endswith("/"):
            continue
        path.append((tag, _name(tag, attributes)))
        yield "+", names(), "", 0
    text = slot()
    if text:
        yield "#", names(), text, links


# --- expressions: tuples of tokens, ("+", expression) and ("?", expression)
#
# A token is "<" and a block's name, or "#" and a mark of a text's path; fixed text has more behind it:
# "#path=text=pages=page=page", the mark of the text, its pages, and the least and greatest mark of a page
# ("#path=text" for the texts of a single page).


def mark_of(text: str, digits: int = 12) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))[:digits]


def _core(x, fixed: set[str]) -> object:
    """What a token matches on: fixed texts on path and text, others on the path, groups on what is in them."""
    while isinstance(x, tuple) and len(x) == 2 and x[0] in ("+", "?"):
        x = x[1] if len(x[1]) > 1 else x[1][0]
    if isinstance(x, tuple):
        return tuple([_core(y, fixed) for y in x])
    if x[0] == "<" or "=" not in x:
        return x
    own = "=".join(x.split("=", 2)[:2])
    return own if own in fixed else x.partition("=")[0]


def _same_text(a: str, b: str, add: bool = True) -> str:
    """Fixed text that meets the same text stays fixed; any other text leaves an open slot."""
    if a == b and not add:
        return a
    head, _, one = a.partition("=")
    other = b.partition("=")[2]
    if not one or not other:
        return head
    (s, n, lo, hi), (t, m, lo2, hi2) = one.split("="), other.split("=")
    if s != t:
        return head
    return f"{head}={s}={int(n) + int(m) if add else max(int(n), int(m))}={min(lo, lo2)}={max(hi, hi2)}"


def _merged(a, b, add: bool = True):
    """The expression of two tokens or groups that match; ``add``: they come from different pages."""
    marks = set()
    inner = []
    for x in (a, b):
        while isinstance(x, tuple):
            marks.add(x[0])
            if len(x[1]) > 1:
                x = x[1]
                break
            x = x[1][0]
        inner.append(x)
    x, y = inner
    out = (_same_text(x, y, add) if x[0] == "#" else x,) if isinstance(x, str) else tuple([_merged(p, q, add) for p, q in zip(x, y, strict=True)])
    if "+" in marks:
        out = (("+", out),)
    if "?" in marks:
        out = (("?", out),)
    return out[0] if len(out) == 1 else out


def fold(stream: list, fixed: set[str] = frozenset()) -> tuple:
    """Equal neighbouring groups become one repeated group, shortest groups first; texts in it merge."""
    out, cores = list(stream), [_core(x, fixed) for x in stream]
    for size in range(1, FOLD + 1):
        if 2 * size > len(out):
            break
        if not any(map(eq, cores, cores[size:])):
            continue
        i, folded, kept = 0, [], []
        while i < len(out):
            j = i + size
            while j + size <= len(out) and cores[j : j + size] == cores[i : i + size]:
                j += size
            if j > i + size:
                merged = out[i : i + size]
                for k in range(i + size, j, size):
                    merged = [_merged(x, y, add=False) for x, y in zip(merged, out[k : k + size], strict=True)]
                one = merged[0]
                folded.append(one if size == 1 and isinstance(one, tuple) and one[0] == "+" else ("+", tuple(merged)))
                kept.append(_core(folded[-1], fixed))
                i = j
            else:
                folded.append(out[i])
                kept.append(cores[i])
                i += 1
        out, cores = folded, kept
    return tuple(out)


def _repeated_as_in(a: list, b: tuple, fixed: set[str]) -> list:
    """a with single groups marked as repeated where the same group repeats in b."""
    cores = [_core(x, fixed) for x in a]
    for group in (x for x in b if isinstance(x, tuple) and x[0] == "+"):
        inner = [_core(x, fixed) for x in group[1]]
        size, i = len(inner), 0
        while i + size <= len(a):
            if cores[i : i + size] == inner and (size > 1 or not isinstance(a[i], tuple)):
                a[i : i + size] = [("+", tuple(a[i : i + size]))]
                cores[i : i + size] = [_core(a[i], fixed)]
            i += 1
    return list(fold(a, fixed))


def _in_common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, the same whatever is held of the table.

    best(i, j) is the longest for a[i:] and b[j:]. A row holds for one j, as bits by n - 1 - i, where best(i, j) is
    best(i + 1, j), so it comes from the row of j + 1 by one addition. Rows are made in blocks from the end; of
    other blocks only the row that they start from is held, and their rows are made again when they are needed.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    before, after, middle = [(k, k) for k in range(lo)], [(n + k, m + k) for k in range(len(a) - n)], []
    width, places, often = n - lo, {}, {}
    for i in range(lo, n):
        places.setdefault(a[i], []).append(n - 1 - i)

    def places_of(x) -> int:
        if x in often:
            return often[x]
        bits, found = bytearray(width // 8 + 1), places[x]
        for k in found:
            bits[k >> 3] |= 1 << (k & 7)
        out = int.from_bytes(bits, "little")
        if len(found) ** 2 >= width:  # so few that they can all be held
            often[x] = out
        return out

    full = (1 << width) - 1

    def row_before(row: int, x) -> int:
        if x not in places:
            return row
        met = row & places_of(x)
        return ((row + met) | (row - met)) & full

    step = max(isqrt(m - lo) + 1, CELLS // max(width, 1))
    row, starts = full, {m: full}
    for j in range(m - 1, lo + step - 1, -1):
        row = row_before(row, b[j])
        if (j - lo) % step == 0:
            starts[j] = row
    i = lo
    for begin in range(lo, m, step):
        end = min(begin + step, m)
        rows = [starts.pop(end)]
        for j in range(end - 1, begin - 1, -1):
            rows.append(row_before(rows[-1], b[j]))
        for j in range(begin, end):
            same = rows.pop().to_bytes(width // 8 + 1, "little")
            while i < n and a[i] != b[j] and same[(n - 1 - i) >> 3] >> ((n - 1 - i) & 7) & 1:
                i += 1
            if i < n and a[i] == b[j]:
                middle.append((i, j))
                i += 1
    return before + middle + after


def fixed_texts(e: tuple) -> tuple[set[str], set[str]]:
    """Texts ("#path=text") that an expression has, and those of them on pages that differ elsewhere."""
    have, sure = set(), set()
    for x in texts_in(e):
        if "=" in x:
            path, text, _, lo, hi = x.split("=")
            have.add(f"{path}={text}")
            if lo != hi:
                sure.add(f"{path}={text}")
    return have, sure


def align(a: tuple, b: tuple) -> tuple:
    """An expression that matches what either matches: common tokens, and the rest as optional groups."""
    (in_a, sure_a), (in_b, sure_b) = fixed_texts(a), fixed_texts(b)
    fixed = (in_a & in_b) | sure_a | sure_b
    a, b = list(fold(a, fixed)), list(fold(b, fixed))
    a, b = _repeated_as_in(a, b, fixed), _repeated_as_in(b, a, fixed)
    out, i, j = [], 0, 0

    def optional(group: list) -> None:
        if group:
            out.append(group[0] if len(group) == 1 and isinstance(group[0], tuple) and group[0][0] == "?" else ("?", tuple(group)))

    for k, p in [*_in_common([_core(x, fixed) for x in a], [_core(x, fixed) for x in b]), (len(a), len(b))]:
        optional(a[i:k])
        optional(b[j:p])
        if k < len(a):
            out.append(_merged(a[k], b[p]))
        i, j = k + 1, p + 1
    return fold(out, fixed)


def expression_text(e: tuple) -> str:
    return json.dumps(e, ensure_ascii=False, separators=(",", ":"))


def expression_of(text: str) -> tuple:
    back = lambda x: tuple(back(y) for y in x) if isinstance(x, list) else x
    return back(json.loads(text))


def texts_in(e: tuple) -> Iterator[str]:
    """The text tokens of an expression."""
    for x in e:
        if isinstance(x, tuple):
            yield from texts_in(x[1])
        elif x[0] == "#":
            yield x


def matches(expression: tuple, stream: list) -> bool:
    """Whether an expression matches a whole stream of tokens (for tests and checks of wrappers)."""

    def one(x: str, y: str) -> bool:
        return x == y or (x[0] == "#" and x.partition("=")[0] == y.partition("=")[0] and (x.split("=")[:2] == y.split("=")[:2] or "=" not in x))

    def ends(e: tuple, starts: set[int]) -> set[int]:
        for x in e:
            if isinstance(x, str):
                starts = {s + 1 for s in starts if s < len(stream) and one(x, stream[s])}
            elif x[0] == "?":
                starts = starts | ends(x[1], starts)
            else:
                seen, now = set(), starts
                while now:
                    now = ends(x[1], now) - seen
                    seen |= now
                starts = seen
            if not starts:
                return starts
        return starts

    return len(stream) in ends(expression, {0})


def stream_of(tokens: list[tuple]) -> tuple[list[str], str]:
    """A page's tokens as an expression has them, texts as those of a single page, and the page's mark."""
    page = mark_of("\n".join(t for kind, _, t, _ in tokens if kind == "#"), 8)
    return [f"<{path[-1]}" if kind == "+" else f"#{mark_of(STEP.join(path), 8)}={mark_of(text)}" for kind, path, text, _ in tokens], page


def with_page(stream: list | tuple, page: str | None) -> tuple:
    """A single page's stream with the page in its texts; other expressions as they are."""
    return tuple(f"{x}=1={page}={page}" if page and x[0] == "#" else x for x in stream)


# --- Spark


def _seen(pages: DataFrame) -> DataFrame:
    """For each batch and host: expressions by shape with their pages, and sums for each slot."""
    schema = "host string, kind string, what string, page string, pages long, chars long, links long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            shapes: dict[tuple, list] = {}
            for url, source in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                host, tokens, slots = host_of(url), list(page_tokens(source or "")), {}
                for kind, path, text, links in tokens:
                    if kind == "#":
                        s = slots.setdefault(STEP.join(path), [0, 0])
                        s[:] = s[0] + len(text), s[1] + links
                for path, (chars, links) in slots.items():
                    s = sums.setdefault((host, "slot", path), [0, 0, 0])
                    s[:] = s[0] + 1, s[1] + chars, s[2] + links
                stream, page = stream_of(tokens)
                key = (host, tuple(x.partition("=")[0] for x in stream))
                if key not in shapes:
                    shapes[key] = [stream, page, 1]
                    continue
                found = shapes[key]  # the same tokens: texts meet one by one
                known = with_page(found[0], found[1])
                found[:] = [_same_text(x, y) if x[0] == "#" else x for x, y in zip(known, with_page(stream, page), strict=True)], None, found[2] + 1
            rows = [(host, kind, path, None, *v) for (host, kind, path), v in sums.items()]
            rows += [(host, "shape", expression_text(tuple(stream)), page, n, 0, 0) for (host, _), (stream, page, n) in shapes.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 4 + [pa.int64()] * 3, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return pages.select("url", "html").mapInArrow(scan, schema)


def _aligned(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["pages", "what"], ascending=[False, True])
    out = None
    for text, page in zip(pdf["what"], pdf["page"], strict=True):
        e = with_page(expression_of(text), page)
        out = e if out is None else align(out, e)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "what": [expression_text(out)], "page": [None], "pages": [int(pdf["pages"].sum())]})


def infer_wrappers(seen: DataFrame) -> DataFrame:
    """host, what (the expression), page (null), pages: one row a host, from the shapes, by rounds of blocks."""
    at = materialise(seen.filter("kind = 'shape'").select("host", "what", "page", "pages"), "shapes")
    while True:
        counts = at.groupBy("host").agg(F.count("*").alias("n"), F.count("page").alias("single"))
        if counts.filter("n > 1 or single > 0").isEmpty():
            return at
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = at.join(counts, "host").withColumn("block", F.pmod(F.xxhash64("what"), blocks))
        alone = dealt.groupBy("host", "block").applyInPandas(_aligned, "host string, what string, page string, pages long")
        at = materialise(alone, "wrappers", instead_of=at)


def _is_outside(path: list[str]) -> bool:
    inside = False
    for name in path:
        tag = name.partition(".")[0]
        inside = inside or tag in MAIN
        if tag in OUTSIDE or (tag == "header" and not inside) or "hidden" in name.split(".")[1:]:
            return True
        if tag not in ("html", "body", *MAIN) and _tells_outside(name, tag in TEXT_TAGS):
            return True
    return False


def _is_main(path: list[str]) -> bool:
    """Whether a block is a main part: by its tag, or by the last word of a class (blog-post, but not post-date)."""
    for name in path:
        tag, *words = name.split(".")
        if tag in MAIN or "main" in words or any((_WORDS.findall(word) or [""])[-1] in MAIN_WORDS for word in words):
            return True
    return False


def template_texts(expression: tuple) -> set[str]:
    """Marks of path and text that an expression holds as fixed on FIXED_PAGES pages or more which differ elsewhere."""
    found = (x[1:].split("=") for x in texts_in(expression) if x.count("=") == 4)
    return {f"{path}={text}" for path, text, n, lo, hi in found if int(n) >= FIXED_PAGES and lo != hi}


def _fixed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fixed = [sorted(template_texts(expression_of(t))) for t in batch.column("what").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(fixed, pa.list_(pa.string()))], names=["host", "fixed"])


def _chosen_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots that are an article's by their place: in a main part, or outside of one with little of it in links."""
    for batch in batches:
        rows = [(h, w, _is_main(w.split(STEP))) for h, w, chars, links in zip(*(batch.column(c).to_pylist() for c in ("host", "what", "chars", "links")), strict=True) if not _is_outside(w.split(STEP)) and (_is_main(w.split(STEP)) or links <= chars / 2)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["host", "path", "main"])


def extract_main_text(pages: DataFrame, names: list[str] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The named columns (default page_id, url) with ``text`` and ``n_chars`` of each page.

    Null or empty html: empty text. Null url: the page's host is the empty one, whose pages make one
    wrapper. Rows stand for themselves, repeated ones too; copies of a page make no text a template's. Named
    columns called text or n_chars are replaced. Very long pages are read and aligned whole.
    Blocks are joined in page order by two newlines.
    """
    names = [c for c in names or ["page_id", "url"] if c not in ("text", "n_chars")]
    seen = materialise(_seen(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))), "seen")
    wrappers = infer_wrappers(seen)
    fixed = wrappers.select("host", "what").mapInArrow(_fixed_texts, "host string, fixed array<string>")
    sums = seen.filter("kind = 'slot'").groupBy("host", "what").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    paths = sums.mapInArrow(_chosen_paths, "host string, path string, main boolean").groupBy("host").agg(F.collect_list(F.when(F.col("main"), F.col("path"))).alias("main"), F.collect_list(F.when(~F.col("main"), F.col("path"))).alias("rest"))
    kept = materialise(fixed.join(paths, "host", "left").select(F.col("host").alias("page_host"), F.struct("fixed", "main", "rest").alias("slots")), "kept")
    remove(seen, wrappers)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("named"), host.alias("page_host"), F.coalesce(F.col(html_col), F.lit("")).alias("page_html"))
    joined = rows.join(kept, "page_host", "left").select("named.*", "page_html", "slots")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2]) + ", text string, n_chars long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = []
                for source, slots in zip(part.columns[-2].to_pylist(), part.columns[-1].to_pylist(), strict=True):
                    texts.append(_article(source, slots or {}))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return joined.mapInArrow(scan, schema)


def _article(source: str, slots: dict) -> str:
    """One page's article: its slots in main parts. Where the slots that are neither main nor the template's hold more text,
    the main parts are a teaser or the like, and all of both is kept."""
    found = [(STEP.join(path), t) for kind, path, t, _ in page_tokens(source) if kind == "#"]
    main, rest, fixed = (set(slots.get(c) or ()) for c in ("main", "rest", "fixed"))
    own = [(path, t) for path, t in found if path in main]
    other = [(path, t) for path, t in found if path in rest and not (fixed and f"{mark_of(path, 8)}={mark_of(t)}" in fixed)]
    size = lambda texts: sum(len(t) for _, t in texts)
    if size(other) > size(own):
        kept = set(other)
        own = [(path, t) for path, t in found if path in main or (path, t) in kept]
    return "\n\n".join(t for _, t in own)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Query: the main text of all pages."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
