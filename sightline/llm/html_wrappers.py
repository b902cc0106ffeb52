"""Main text of web pages by wrapper induction.

Pages of a host are aligned by simple tree matching into one wrapper per host. Pages of one text count
once. Nodes whose text is the same on most pages are template, nodes whose text varies or that few
pages have are slots. The content region is the
smallest container that holds all varying text outside menus and the like; each page is aligned
with its host's wrapper, and the text of what matches the region comes out, block by block.

Trees hold block elements only; inline markup belongs to the text of its block. Equal siblings are
repeated nodes, two at most, so that a tree is as large as its layout, not as its text.
"""

from __future__ import annotations

import html as entities
import json
import re
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import BATCH_ROWS, free_name, stored, with_columns_in_arrow

#: Wrappers of all hosts together are sent to every task up to this size; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Partial wrappers of a host are first merged in so many groups.
SALTS = 64
#: Digests of pages a task remembers, so as to hand on one copy only; beyond that it starts anew. Changes no count.
REMEMBERED = 1_000_000
#: Elements nested deeper than this stand beside each other; no text is lost, and what is left out stays so.
DEEPEST = 150

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split()
)
#: Elements that close an open paragraph.
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Elements that close an open one of these, and where the search for it ends.
CLOSE_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "thead": ({"tr", "td", "th", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}),
}
CONTAINERS = frozenset("html body div section main article center table tbody tr td #root".split())
MAIN = ("article", "main")
NEVER = frozenset("head nav footer aside form script style noscript template iframe title textarea button select option dialog menu svg canvas object audio video".split())
#: Words of a class or id that mark what is not content.
NEVER_NAMED = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted recommended related share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: What stands before such a word ("site-footer") or after it ("comment-list") in a whole name. Other
#: names that merely hold the word ("no-sidebar", "post-header") mark nothing.
NAMED_BEFORE = frozenset("site page main global top bottom left right primary secondary".split())
NAMED_AFTER = frozenset("list box area section wrap wrapper container block bar panel links slot unit form thread".split())
#: No name leaves these out.
NEVER_BY_NAME = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_NOT_SHOWN = re.compile(r"style\s*=\s*[\"']?[^\"'>]*display\s*:\s*none", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass
class Node:
    """A block element of a page. `parts` are texts and children in page order."""

    tag: str
    classes: str
    left_out: bool
    parts: list = field(default_factory=list)

    @property
    def label(self) -> str:
        """Tag and classes, digits as one mark, so that a number of its own does not part a page from the others."""
        return f"{self.tag}.{self.classes}" if self.classes else self.tag


def names_what_is_left_out(name: str) -> bool:
    """Whether a class, id or role as a whole names a menu, an advert or the like."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    if len(words) == 1:
        return words[0] in NEVER_NAMED
    return len(words) == 2 and (words[0] in NAMED_BEFORE and words[1] in NEVER_NAMED or words[0] in NEVER_NAMED and words[1] in NAMED_AFTER)


def element(tag: str, attributes: str) -> Node:
    named = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if "=" in attributes else {}
    names = [w for k in ("class", "id", "role") for w in named.get(k, "").lower().split()]
    hidden = bool(attributes and (_HIDDEN.search(_QUOTED.sub("''", attributes)) or _NOT_SHOWN.search(attributes)))
    classes = " ".join(sorted({re.sub(r"[0-9]+", "0", w) for w in named.get("class", "").lower().split()}))
    return Node(tag, classes, tag in NEVER or hidden or tag not in NEVER_BY_NAME and any(map(names_what_is_left_out, names)))


def parse(page: str) -> Node:
    """A tolerant reading: missing end tags are supplied, a tag cut off at the end is dropped."""
    root = Node("#root", "", False)
    stack, at, size = [root], 0, len(page)
    # Open elements below DEEPEST, with their place on the stack if they are on it, and open inline
    # elements inside one that is left out, down to that one.
    deep: list[tuple[str, int | None]] = []
    inline: list[str] = []
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].parts.append(page[at:])
            break
        if lt > at:
            stack[-1].parts.append(page[at:lt])
        m = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]) and page.find(">", lt) < 0:
                break
            stack[-1].parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m.lastindex or not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if tag in inline:
                    while inline.pop() != tag:
                        pass
                    if not inline:
                        stack.pop()
                continue
            if any(t == tag for t, _ in deep):
                while True:
                    t, place = deep.pop()
                    if place is not None:
                        del stack[place:]
                    if t == tag:
                        break
                stack[-1].parts.append(Node(tag, "", False))
                inline.clear()
                continue
            if tag == "p" and all(n.tag != "p" for n in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    inline.clear()
                    deep.clear()
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "br":
                stack[-1].parts.append(" ")
            elif tag not in VOID and (inline or m[3]):
                if not inline and (node := element(tag, m[3])).left_out:
                    stack[-1].parts.append(node)
                    stack.append(node)
                    inline.append(tag)
                elif inline:
                    inline.append(tag)
            continue
        if inline:  # a block ends what is open in the line
            stack.pop()
            inline.clear()
        if tag in CLOSE_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag not in INLINE:
                    break
        if tag in CLOSE_SAME:
            same, ends = CLOSE_SAME[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ends:
                    break
                if stack[depth].tag in same:
                    del stack[depth:]
                    break
        node = element(tag, m[3])
        stack[-1].parts.append(node)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            if len(stack) < DEEPEST:
                stack.append(node)
            elif node.left_out and not stack[-1].left_out:
                deep.append((tag, len(stack)))
                stack.append(node)
            else:
                deep.append((tag, None))
    return root


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


# A wrapper node is a dict: l label, n pages, t digest of its own text (None: it varies), x whether it
# has text, c children. A page is a wrapper of one page, and two wrappers merge into one.


def outline(node: Node) -> dict:
    """A page as a wrapper, with the nodes that stand behind each wrapper node under "at"."""
    return _outlined([node])


def _outlined(nodes: list[Node]) -> dict:
    own = clean("\n".join(p for n in nodes for p in n.parts if isinstance(p, str)))
    # Of each label the first run of neighbours is one child and all later ones another, so a node has
    # at most two children of a label, however long the page is.
    runs: list[list[Node]] = []
    first: dict[tuple[str, bool], list[Node]] = {}
    later: dict[tuple[str, bool], list[Node]] = {}
    last = None
    for n in nodes:
        for child in (p for p in n.parts if isinstance(p, Node)):
            key = (child.label, child.left_out)
            if key not in first:
                first[key] = run = []
                runs.append(run)
            elif key == last:
                run = later.get(key, first[key])
            elif key in later:
                run = later[key]
            else:
                later[key] = run = []
                runs.append(run)
            run.append(child)
            last = key
    return {"l": nodes[0].label, "n": 1, "t": blake2b(own.encode(), digest_size=6).hexdigest() if own else "", "x": bool(own), "b": nodes[0].left_out, "c": [_outlined(r) for r in runs], "at": nodes}


def matching(a: list[dict], b: list[dict], known: dict | None = None) -> list[tuple[int, int]]:
    """Pairs of children that a simple tree matching aligns, in order. `known` holds the matches of
    pairs of nodes that were looked at before."""
    m, n = len(a), len(b)
    if m == n and all(x["l"] == y["l"] for x, y in zip(a, b, strict=True)):
        return [(i, i) for i in range(m)]
    known = {} if known is None else known
    weight = [[0] * (n + 1) for _ in range(m + 1)]
    won = [[0] * n for _ in range(m)]
    for i in range(m):
        for j in range(n):
            w = tree_match(a[i], b[j], known)
            won[i][j] = w
            weight[i + 1][j + 1] = max(weight[i][j + 1], weight[i + 1][j], weight[i][j] + w)
    pairs, i, j = [], m, n
    while i and j:
        if won[i - 1][j - 1] and weight[i][j] == weight[i - 1][j - 1] + won[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif weight[i][j] == weight[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def tree_match(a: dict, b: dict, known: dict | None = None) -> int:
    """Most nodes of the two trees that can be paired with labels, ancestry and order kept."""
    if a["l"] != b["l"]:
        return 0
    known = {} if known is None else known
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1 + sum(tree_match(a["c"][i], b["c"][j], known) for i, j in matching(a["c"], b["c"], known))
    return known[key]


def merge(a: dict, b: dict, known: dict | None = None) -> dict:
    """One wrapper of two with the same label at the root. What only one has is kept in its place."""
    known = {} if known is None else known
    out = {"l": a["l"], "n": a["n"] + b["n"], "t": a["t"] if a["t"] == b["t"] else None, "x": a["x"] or b["x"], "b": a["b"], "c": []}
    i = j = 0
    for p, q in [*matching(a["c"], b["c"], known), (len(a["c"]), len(b["c"]))]:
        out["c"] += [_alone(x) for x in a["c"][i:p]] + [_alone(x) for x in b["c"][j:q]]
        if p < len(a["c"]):
            out["c"].append(merge(a["c"][p], b["c"][q], known))
        i, j = p + 1, q + 1
    return out


def _alone(x: dict) -> dict:
    return {"l": x["l"], "n": x["n"], "t": x["t"], "x": x["x"], "b": x["b"], "c": [_alone(y) for y in x["c"]]}


def varies(w: dict, pages: int) -> bool:
    """Whether text differs between pages somewhere below, or was not seen on most of the host's `pages`."""
    return not w["b"] and (w["x"] and (w["t"] is None or 2 * w["n"] <= pages or pages == 1) or any(varies(c, pages) for c in w["c"]))


def has_text(w: dict) -> bool:
    return not w["b"] and (w["x"] or any(has_text(c) for c in w["c"]))


def region_of(w: dict) -> list[int]:
    """Way to the content region: child numbers from the root."""
    way: list[int] = []
    pages = w["n"]
    if not varies(w, pages):
        pages = 1  # copies of one page: nothing is known to be template
    while w["l"].split(".")[0] not in MAIN and not (w["x"] and (w["t"] is None or pages == 1)):
        slots = [i for i, c in enumerate(w["c"]) if varies(c, pages)]
        main = [i for i in slots if w["c"][i]["l"].split(".")[0] in MAIN]
        to = main if len(main) == 1 else slots
        if len(to) != 1 or w["c"][to[0]]["l"].split(".")[0] not in CONTAINERS:
            break
        way.append(to[0])
        w = w["c"][to[0]]
    return way


def region_nodes(page: dict, wrapper: dict, way: list[int]) -> tuple[list[Node], dict, dict] | None:
    """The page's nodes at the region, aligned level by level; None if the page lacks it."""
    for step in way:
        partner = next((i for i, j in matching(page["c"], wrapper["c"]) if j == step), None)
        if partner is None:
            return None
        page, wrapper = page["c"][partner], wrapper["c"][step]
    return page["at"], page, wrapper


def template_nodes(page: dict, wrapper: dict, pages: int, out: set[int]) -> None:
    """Nodes outside an article whose text is the same on three pages or more and on most of the host's `pages`."""
    for i, j in matching(page["c"], wrapper["c"]):
        p, w = page["c"][i], wrapper["c"][j]
        if w["l"].split(".")[0] in MAIN:
            continue
        if w["n"] >= 3 and has_text(w) and not varies(w, pages):
            out.update(map(id, p["at"]))
        else:
            template_nodes(p, w, pages, out)


def blocks(nodes: list[Node], template: set[int]) -> list[str]:
    """Texts of the blocks below, in page order, without what is never content."""
    out, open_ = [], []

    def close() -> None:
        text = clean("".join(open_))
        open_.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            open_.append(x)
        elif not (x.left_out or id(x) in template):
            close()
            todo.append(None)
            todo.extend(reversed(x.parts))
    close()
    return out


def main_text(page: str | None, wrapper: str | None) -> str:
    """Text of the content region, one line per block. Without a wrapper the page is its own."""
    if not page:
        return ""
    seen = outline(parse(page))
    found, template = None, set()
    if wrapper:
        w = json.loads(wrapper)
        found = region_nodes(seen, w, w["way"])
        if found and w["way"] is not None and found[2]["l"].split(".")[0] not in MAIN and w["n"] >= 3 and varies(found[2], w["n"]):
            template_nodes(found[1], found[2], w["n"], template)
    if not found:
        found = region_nodes(seen, seen, region_of(seen))
    return "\n".join(blocks(found[0], template))


def host_of(url: Column) -> Column:
    """Host in lower case without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) over the distinct pages of each host: those of one text, without what is never
    content, are one page. Outlines are dealt out by text, each task hands on one per text and then
    folds its distinct ones into partial wrappers; those of a host are merged in SALTS groups and
    then into one, in a fixed order."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("salt", T.IntegerType()), T.StructField("wrapper", T.StringType())])

    def outlines(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page)
                text = "\n".join(blocks([root], set()))
                mark = blake2b(f"{host}\n{text}".encode("utf-8", "replace"), digest_size=16).digest()
                if mark not in seen:
                    seen.add(mark)
                    rows.append((host, mark, json.dumps(_alone(outline(root)))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], names=["host", "mark", "wrapper"])
            if len(seen) > REMEMBERED:
                seen.clear()

    def partial(batches):
        """Rows come sorted by host and mark."""
        host = mark = kept = None

        def out():
            text = json.dumps(kept)
            salt = int(blake2b(text.encode(), digest_size=4).hexdigest(), 16) % SALTS
            return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([salt], pa.int32()), pa.array([text])], names=schema.fieldNames())

        for batch in batches:
            for h, m, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != host:
                    if kept:
                        yield out()
                    host, mark, kept = h, m, json.loads(text)
                elif m != mark:
                    mark, kept = m, merge(kept, json.loads(text))
        if kept:
            yield out()

    def together(frame: pd.DataFrame) -> dict:
        all_ = [json.loads(s) for s in sorted(frame["wrapper"])]
        made = all_[0]
        for w in all_[1:]:
            made = merge(made, w)
        return made

    def in_group(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(together(frame))]})

    def at_last(key, frame: pd.DataFrame) -> pd.DataFrame:
        made = together(frame)
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(made | {"way": region_of(made)})]})

    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html")).where("host is not null and html is not null")
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    seen = rows.mapInArrow(outlines, "host string, mark binary, wrapper string")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = seen.repartition(n, "host", "mark").sortWithinPartitions("host", "mark", "wrapper")
    made = dealt.mapInArrow(partial, schema).groupBy("host", "salt").applyInPandas(in_group, "host string, wrapper string")
    return made.groupBy("host").applyInPandas(at_last, "host string, wrapper string")


def extracted(pages: DataFrame, url: str = "url", html: str = "html", to: str = "main_text") -> DataFrame:
    """All columns and rows, with the main text in `to` (replacing a column of that name).

    Null and empty pages give an empty text; a page without a host, or alone on its host, is read
    by itself. Repeated pages give the same text. The wrappers take part by a broadcast up to
    BROADCAST_BYTES and by a shuffled join beyond.
    """
    induced = stored(wrappers(pages, url, html))
    size = induced.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    host, wrapper = free_name(pages, "host"), free_name(pages, "wrapper")
    side = induced.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    df = pages.withColumn(host, host_of(F.col(f"`{url}`"))).join(F.broadcast(side) if size <= BROADCAST_BYTES else side, host, "left")

    def work():
        def do(page: pa.Array, known: pa.Array) -> list[pa.Array]:
            return [pa.array([main_text(p, w) for p, w in zip(page.to_pylist(), known.to_pylist(), strict=True)], pa.string())]

        return do

    return with_columns_in_arrow(df, [html, wrapper], {to: T.StringType()}, work).drop(host, wrapper)


def texts_of(pages: DataFrame) -> DataFrame:
    """Per page: its main text and how many code points it has."""
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
