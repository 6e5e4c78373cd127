"""Main text of web pages: markup first, then a suffix array over the pages of a host.

A page is cut into blocks. Text inside furniture (by element, role, class or id: menus, footers,
sidebars, adverts, forms, comments) is dropped. Where a page marks its article, the article is kept
whole. All other text is undecided: the undecided token streams of a host's pages are concatenated,
a suffix array shows the runs of `MIN_RUN` tokens or more that occur on distinct pages, the words
they cover are boilerplate, and the unique runs are kept.

A host's pages are dealt to shards of bounded size. Each shard's suffix array groups equal windows of
`MIN_RUN` tokens; the groups, one row each, are merged over shards by fingerprint, so a run repeated
in two shards counts as one repeated in one. (A window is repeated exactly if it lies in a repeated
run of that length or more, so the cover is the same as that of one suffix array of the host.)
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._scratch import table

MIN_RUN = 10
SHARD_TOKENS = 1_000_000
RAW = {"script", "style", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "option", "title", "tbody", "td", "tfoot", "th", "thead", "tr"}
FURNITURE = set(
    "head title nav footer aside form script style noscript template iframe object button select option textarea label fieldset svg canvas "
    "audio video dialog menu math map".split()
)
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond "
    "share sharing social related recommended widget pagination pager skip toolbar".split()
)
#: Furniture of a page, but a part of an article.
PAGE_WORDS = set("header masthead banner topbar".split())
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)|</[^>]*(?:>|$)|<[a-zA-Z][^>]*(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _role(name: str, attributes: str, in_article: bool) -> str | None:
    """`drop`, `article`, `main` or None for an element that begins."""
    if name in FURNITURE or name == "header" and not in_article:
        return "drop"
    role = "article" if name == "article" else "main" if name == "main" else None
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" and value != "until-found":
                return "drop"
            if key == "role":
                if value in FURNITURE_ROLES:
                    return "drop"
                role = role or ({"main": "main", "article": "article"}.get(value))
            elif key in ("class", "id") and name not in ("html", "body", "main"):
                words = set(_PARTS.split(value))
                if words & FURNITURE_WORDS or not in_article and name != "article" and words & PAGE_WORDS:
                    return "drop"
    return role


def page_blocks(page: str) -> list[tuple[str, str]]:
    """`(zone, text)` of each block in page order; zone is `article`, `main` or `other`. Furniture is left out.

    References are decoded and white space is one space. Unclosed and cut-off markup is taken as far as it goes.
    """
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str | None]] = []
    open_roles = {"drop": 0, "article": 0, "main": 0}
    text: list[str] = []

    def zone() -> str:
        return "article" if open_roles["article"] else "main" if open_roles["main"] else "other"

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                blocks.append((zone(), words))
            text.clear()

    def pop_to(i: int) -> None:
        while len(stack) > i:
            role = stack.pop()[1]
            if role:
                flush()
                open_roles[role] -= 1

    def find(name: str) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                return i
        return -1

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if not open_roles["drop"]:
            text.append(page[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[4] != ">":  # cut off: markup up to the end
            break
        if name in BLOCK:
            flush()
        elif name == "br":
            text.append(" ") if not open_roles["drop"] else None
        if m[1]:
            i = find(name)
            if i >= 0:
                pop_to(i)
            continue
        if name in CLOSES_P and (i := find("p")) >= 0:
            pop_to(i)
        elif name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop_to(len(stack) - 1)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        role = _role(name, m[3], bool(open_roles["article"]))
        if role:
            flush()
            open_roles[role] += 1
        stack.append((name, role))
    flush()
    return blocks


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked text of each page, and its undecided blocks."""
    for batch in batches:
        marked, undecided = [], []
        for page in batch.column("html").to_pylist():
            blocks = page_blocks(page or "")
            zones = {z for z, _ in blocks}
            best = "article" if "article" in zones else "main" if "main" in zones else None
            marked.append(None if best is None else " ".join(t for z, t in blocks if z == best))
            undecided.append([t for z, t in blocks if z == "other"])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("page_id"), batch.column("url"), pa.array(marked, pa.string()), pa.array(undecided, pa.list_(pa.string()))], ["row", "page_id", "url", "marked", "undecided"])


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position's first `depth` tokens (prefix doubling); equal ranks mean equal tokens.

    A position with fewer tokens left than `depth` has a rank of its own kind: the end sorts first.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, done = len(tokens), 1
    while done < depth:
        step = min(done, depth - done)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        r, a = rank[order], after[order]
        new = np.r_[0, np.cumsum((r[1:] != r[:-1]) | (a[1:] != a[:-1]))] if n else rank
        rank = np.empty(n, np.int64)
        rank[order] = new
        done += step
    return rank


def _fingerprints(tokens: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros(max(0, len(tokens) - depth + 1), np.uint64)
    for i in range(depth):
        out = (out ^ tokens[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _stream(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the pages one after the other, and the page number of each token."""
    import xxhash

    words = [[w for block in p for w in block.split()] for p in pages]
    tokens = np.fromiter((xxhash.xxh64_intdigest(w) for p in words for w in p), np.uint64)
    return tokens, np.repeat(np.arange(len(words)), [len(p) for p in words])


def _inside(owner: np.ndarray, depth: int) -> np.ndarray:
    """Whether the window that begins at each position stays within one page."""
    n = len(owner) - depth + 1
    return owner[:n] == owner[depth - 1 :] if n > 0 else np.zeros(0, bool)


def _grouped(depth: int):
    def run(shard: pa.Table) -> pa.Table:
        """One row per distinct window of the shard: its fingerprint and the least and last page that has it."""
        ids = np.array(shard.column("row").to_pylist(), np.int64)
        tokens, owner = _stream(shard.column("undecided").to_pylist())
        inside = _inside(owner, depth)
        starts = np.flatnonzero(inside)
        rank = suffix_ranks(tokens, depth)[starts] if len(starts) else np.zeros(0, np.int64)
        order = np.argsort(rank, kind="stable")
        starts = starts[order]
        first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]]) if len(starts) else np.zeros(0, int)
        page = ids[owner[starts]] if len(starts) else np.zeros(0, np.int64)
        prints = _fingerprints(tokens, depth)[starts[first]].view(np.int64) if len(starts) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(page, first) if len(first) else page
        last = np.maximum.reduceat(page, first) if len(first) else page
        host, number = shard.column("host")[0], shard.column("shard")[0]
        return pa.table({"host": pa.array([host.as_py()] * len(first), pa.string()), "shard": pa.array([number.as_py()] * len(first), pa.int64()), "window": prints, "least": least, "last": last})

    return run


def _kept(depth: int):
    def run(shard: pa.Table, repeated: pa.Table) -> pa.Table:
        """Unique runs of each page of the shard, and how many words repeated runs cover."""
        pages = shard.column("undecided").to_pylist()
        tokens, owner = _stream(pages)
        known = np.array(repeated.column("window").to_pylist(), np.int64).view(np.uint64)
        hit = np.flatnonzero(np.isin(_fingerprints(tokens, depth), known) & _inside(owner, depth))
        cover = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, np.minimum(hit + depth, len(tokens)), -1)
        covered = np.cumsum(cover)[:-1] > 0
        words = [w for p in pages for block in p for w in block.split()]
        texts: list[list[str]] = [[] for _ in pages]
        for i in np.flatnonzero(~covered):
            texts[owner[i]].append(words[i])
        return pa.table({"row": shard.column("row"), "unique": pa.array([" ".join(t) for t in texts], pa.string()), "repeated": np.bincount(owner, covered, len(pages)).astype(np.int64)})

    return run


def main_text(
    pages: DataFrame,
    *,
    page_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_run: int = MIN_RUN,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per row of `pages`: `(page_id, url, text, n_chars, repeated_words)`.

    text is the article where the page marks one, else the unique runs of its undecided text;
    repeated_words counts the undecided words that repeated runs cover. A null or empty page has an
    empty text. Hosts are compared in lower case; pages without one, null urls included, share the
    empty host. Repeated rows are distinct pages. Very long pages are read whole.
    """
    source = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    types = dict(source.dtypes)
    columns = f"row long, page_id {types['page_id']}, url string, marked string, undecided array<string>"
    rows = table(source.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "url", "html").mapInArrow(_split, columns), "blocks")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\w+://([^/:?#]*)", 1)), F.lit(""))
    streams = rows.where(F.size("undecided") > 0).select("row", host.alias("host"), "undecided")
    length = F.aggregate("undecided", F.lit(0).cast("long"), lambda n, t: n + F.floor(F.length(t) / 4) + 1)
    sizes = streams.groupBy("host").agg(F.sum(length).alias("tokens")).select("host", F.ceil(F.col("tokens") / shard_tokens).alias("shards"))
    streams = table(streams.join(sizes, "host").select("row", "host", F.pmod(F.xxhash64("row"), "shards").alias("shard"), "undecided"), "streams")
    windows = table(streams.groupBy("host", "shard").applyInArrow(_grouped(min_run), "host string, shard long, window long, least long, last long"), "windows")
    repeated = windows.groupBy("host", "window").agg(F.min("least").alias("a"), F.max("last").alias("b")).where("a < b").select("host", "window")
    here = windows.select("host", "shard", "window").join(repeated, ["host", "window"], "left_semi")
    unique = (
        streams.groupBy("host", "shard")
        .cogroup(here.groupBy("host", "shard"))
        .applyInArrow(_kept(min_run), "row long, unique string, repeated long")
    )
    # only rows with undecided text are joined; the others' texts aren't shuffled
    joined = rows.where(F.size("undecided") > 0).join(unique, "row", "left").select("page_id", "url", "marked", "unique", "repeated")
    plain = rows.where(F.size("undecided") == 0).select("page_id", "url", "marked", F.lit(None).cast("string").alias("unique"), F.lit(0).cast("long").alias("repeated"))
    text = F.coalesce("marked", "unique", F.lit(""))
    return joined.unionByName(plain).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.coalesce("repeated", F.lit(0)).cast("long").alias("repeated_words"))
