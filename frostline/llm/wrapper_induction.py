"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.workspace import map_rows, saved, text_rows

# fixed values of HTML
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - set("body head html tbody td tfoot th thead tr".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table article section div main body html td th".split())
#: Elements that introduce what follows them, with their rank.
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "dt": 6, "th": 6}
#: Elements and names of classes, ids and roles that are not the article.
APART = set(
    "head nav header footer aside form script style noscript template title button select "
    "textarea iframe svg menu dialog object canvas".split()
)
ASIDES = set("ad ads advert comment comments promo related sponsored".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|sidebar|menu|nav|navbar|"
    r"navigation|breadcrumbs?|header|footer|masthead|cookies?|consent|notice|popup|modal|newsletter|"
    r"subscribe|share|sharing|social|related|comments?|disqus|respond|widget|toolbar|complementary|"
    r"contentinfo|search)(?:$|[\s_-])",
    re.I,
)
#: Of these, names that say how an element looks; the wrapper decides first, where it can.
_LOOKS = re.compile(
    r"(?:^|(?<=[\s_-]))(?:banner|header|masthead|notice|popup|modal|share|sharing|social|widget|toolbar|"
    r"complementary|search)(?=$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    """An element: tag, names (class, id, role), class alone, children (elements and pieces of text)."""

    __slots__ = ("tag", "names", "kind", "children", "number", "shape")

    def __init__(self, tag: str, names: str = "", kind: str = ""):
        self.tag, self.names, self.kind, self.children, self.number, self.shape = tag, names, kind, [], -1, -1

    @property
    def label(self) -> tuple[str, str]:
        return self.tag, self.kind

    def elements(self) -> list[Node]:
        return [c for c in self.children if type(c) is Node]

    def own_text(self) -> str:
        return " ".join(" ".join(c.split()) for c in self.children if isinstance(c, str)).strip()


def parse(page: str, depth: int | None = None) -> Node:
    """The element tree of a page; unclosed and misplaced tags are mended as browsers do.

    Given a depth, the tree has no texts and only elements down to there."""
    root = Node("#page")
    stack = [root]
    deeper: dict[str, Node] = {}  # one element for all below the depth with its tag
    opened: dict[str, int] = {}
    at, n = 0, len(page)

    def add(text: str) -> None:
        if text and depth is None:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def close(tags: set[str], stop: set[str]) -> None:
        if not any(map(opened.get, tags)):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                for x in stack[k:]:
                    opened[x.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    search = _TOKEN.search
    while at < n:
        m = search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at and depth is None:
            add(page[at : m.start()])
        at = m.end()
        ends, tag, names = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if ends:
            if len(stack) > 1 and stack[-1].tag == tag:
                opened[tag] -= 1
                stack.pop()
            else:
                close({tag}, {"#page"} if tag in BLOCK else SCOPE)
            continue
        if tag in ENDS_P and opened.get("p"):
            close({"p"}, SCOPE)
        if tag in SAME:
            close(SAME[tag], SCOPE - {"td", "th"} if tag in ("td", "th") else SCOPE)
        if depth is None or len(stack) <= depth:
            found = _ATTRIBUTE.findall(names) if names else ()
            if found:
                kind = " ".join(a or b or c for name, a, b, c in found if name.lower() == "class")
                node = Node(tag, " ".join(a or b or c for _, a, b, c in found), kind)
            else:
                node = Node(tag)
            stack[-1].children.append(node)
        else:
            node = deeper.get(tag) or deeper.setdefault(tag, Node(tag))
        if tag in VOID or names.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            stop = end.start() if end else n
            if depth is None:
                node.children.append(page[at:stop])
            close_at = page.find(">", stop)
            at = n if close_at < 0 else close_at + 1
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root


def numbered(root: Node) -> list[Node]:
    """All elements in page order, each with its number."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo += reversed(node.elements())
    return out


#: Cells of one alignment table; longer rows of siblings are halved until they fit.
CELLS = 1 << 20


def _scores(rows, b: int, y: int, kept: list | None = None) -> np.ndarray:
    """The best total for all rows of weights with every prefix of the columns from b to y."""
    best = np.zeros(y - b + 1, np.int64)
    for w in rows:
        new = best.copy()
        np.maximum(new[1:], np.where(w > 0, best[:-1] + w, 0), out=new[1:])
        best = np.maximum.accumulate(new)
        if kept is not None:
            kept.append(best)
    return best


def _best_pairs(m: int, n: int, weights) -> list[tuple[int, int]]:
    """Places (i, j), in order on both sides, of the greatest total weight; `weights(i, b, y)`
    are those of i with the places from b to y."""
    out, todo = [], [(0, m, 0, n)]
    while todo:
        a, z, b, y = todo.pop()
        if a == z or b == y:
            continue
        if z - a > 1 and (z - a) * (y - b) > CELLS:
            middle = (a + z) // 2
            ahead = _scores((weights(i, b, y) for i in range(a, middle)), b, y)
            behind = _scores((weights(i, b, y)[::-1] for i in range(z - 1, middle - 1, -1)), b, y)[::-1]
            cut = b + int((ahead + behind).argmax())
            todo += [(a, middle, b, cut), (middle, z, cut, y)]
            continue
        rows = [np.zeros(y - b + 1, np.int64)]
        _scores((weights(i, b, y) for i in range(a, z)), b, y, rows)
        i, j = z - a, y - b
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, b + j))
    return sorted(out)


def align(a: Node, b: Node) -> dict[int, int]:
    """Simple tree matching: numbers of b's elements for those of a, matched in order below
    matched parents so that most elements match. Elements match by their tag; where there is
    a choice, those of one class do."""
    return aligner(a)(numbered(b))


class _Shapes:
    """Numbers for subtrees (tags and classes) that are equal, and for the rows of children below
    them; what two such rows have in common is found once for all trees, whatever holds them."""

    def __init__(self):
        self.numbers: dict = {}
        self.tags: list[int] = []  # of each shape: its tag, class and row of children, as numbers
        self.kinds: list[int] = []
        self.below: list[int] = []
        self.counts: list[int] = []
        self.names: dict[str, int] = {}
        self.rows: dict[tuple, int] = {(): 0}
        self.children: list[tuple] = [()]
        self.elements: list[int] = [0]  # in all subtrees of a row
        self.common: dict[tuple[int, int], int] = {}

    def give(self, order: list[Node]) -> None:
        """Gives all elements of a tree the numbers of their subtrees."""
        names = self.names
        for node in reversed(order):
            children = tuple(c.shape for c in node.elements())
            row = self.rows.setdefault(children, len(self.children))
            if row == len(self.children):
                self.children.append(children)
                self.elements.append(sum(self.counts[k] for k in children))
            tag, kind = names.setdefault(node.tag, len(names)), names.setdefault(node.kind, len(names))
            node.shape = self.numbers.setdefault((tag, kind, row), len(self.tags))
            if node.shape == len(self.tags):
                self.tags.append(tag)
                self.kinds.append(kind)
                self.below.append(row)
                self.counts.append(1 + self.elements[row])

    def ends(self, left: tuple, right: tuple) -> tuple[list[tuple[int, int]], int, int, int]:
        """Places that surely match: equal subtrees at the front and at the back, and what stands
        alone between them with one tag; then the front and both ends of what is to be weighed."""
        most = min(len(left), len(right))
        front = 0
        while front < most and left[front] == right[front]:
            front += 1
        back = 0
        while back < most - front and left[-1 - back] == right[-1 - back]:
            back += 1
        m, n = len(left) - back, len(right) - back
        sure = [(i, i) for i in range(front)] + [(m + i, n + i) for i in range(back)]
        if m == n == front + 1:
            if self.tags[left[front]] == self.tags[right[front]]:
                sure.append((front, front))
            return sure, front, front, front
        return sure, front, m, n

    def unknown(self, pairs) -> list[tuple[int, int]]:
        """Of pairs of shapes, the rows of children not yet compared."""
        rows = {(self.below[s], self.below[t]) for s, t in pairs}
        return [r for r in rows if r[0] and r[1] and r[0] != r[1] and r not in self.common]

    def crossed(self, left: tuple, right: tuple):
        """A pair of shapes for every two rows of children to be compared to weigh siblings."""
        sides = []
        for side in (left, right):
            by_tag: dict[int, dict[int, int]] = {}
            for s in set(side):
                by_tag.setdefault(self.tags[s], {})[self.below[s]] = s
            sides.append(by_tag)
        for tag, own in sides[0].items():
            for t in sides[1].get(tag, {}).values():
                for s in own.values():
                    yield s, t

    def inside(self, f: int, g: int) -> int:
        """What two rows of children have in common, once it is known."""
        return 3 * self.elements[f] if f == g else self.common[f, g] if f and g else 0

    def chosen(self, left: tuple, right: tuple) -> list[tuple[int, int]]:
        """Places of siblings, matched in order for the greatest weight of their subtrees."""
        number = {t: k for k, t in enumerate(dict.fromkeys(right))}
        other, codes = list(number), np.array([number[t] for t in right])
        tags, kinds, below = ([x[t] for t in other] for x in (self.tags, self.kinds, self.below))
        classes = np.array(kinds)
        held, keep = {}, len(set(left)) * len(other) <= CELLS
        heads: dict[tuple[int, int], np.ndarray] = {}

        def inner(tag: int, f: int) -> np.ndarray:
            known = {g: 2 + self.inside(f, g) for g, t in zip(below, tags) if t == tag}
            return np.array([known[g] if t == tag else 0 for g, t in zip(below, tags)], np.int64)

        def weights(i: int, b: int, y: int) -> np.ndarray:
            s = left[i]
            row = held.get(s)
            if row is None:
                head = self.tags[s], self.below[s]
                base = heads.get(head)
                if base is None:
                    if not keep:
                        heads.clear()
                    base = heads[head] = inner(*head)
                row = base + ((base > 0) & (classes == self.kinds[s]))
                if keep:
                    held[s] = row
            return row[codes[b:y]]

        return _best_pairs(len(left), len(right), weights)

    def measure(self, todo: list[tuple[int, int]]) -> None:
        """Finds what rows of children have in common; no step is recursive."""
        while todo:
            f, g = todo[-1]
            if (f, g) in self.common:
                todo.pop()
                continue
            left, right = self.children[f], self.children[g]
            sure, front, m, n = self.ends(left, right)
            x, y = left[front:m], right[front:n]
            missing = self.unknown([(left[i], right[j]) for i, j in sure])
            missing += self.unknown(self.crossed(x, y)) if x and y else []
            if missing:
                todo += missing
                continue
            if x and y:
                sure += [(front + i, front + j) for i, j in self.chosen(x, y)]
            self.common[f, g] = sum(
                (3 if self.kinds[s] == self.kinds[t] else 2) + self.inside(self.below[s], self.below[t])
                for s, t in ((left[i], right[j]) for i, j in sure)
            )


def aligner(a: Node):
    """Aligns trees with `a`, as `align` does, given their elements as `numbered` has them.

    Equal subtrees match as they are, and what two shapes of subtrees have in common is found
    once for all trees. No step is recursive, so trees may be of any depth.
    """
    shapes = _Shapes()
    shapes.give(numbered(a))

    def matched(order: list[Node]) -> dict[int, int]:
        shapes.give(order)
        out: dict[int, int] = {}
        todo = [(a, order[0])] if a.tag == order[0].tag else []
        while todo:
            x, y = todo.pop()
            if x.shape == y.shape:
                n = shapes.counts[x.shape]
                out.update(zip(range(x.number, x.number + n), range(y.number, y.number + n)))
                continue
            out[x.number] = y.number
            left, right = x.elements(), y.elements()
            one, other = (shapes.children[shapes.below[z.shape]] for z in (x, y))
            sure, front, m, n = shapes.ends(one, other)
            todo += [(left[i], right[j]) for i, j in sure]
            one, other = one[front:m], other[front:n]
            if one and other:
                shapes.measure(shapes.unknown(shapes.crossed(one, other)))
                todo += [(left[front + i], right[front + j]) for i, j in shapes.chosen(one, other)]
        return out

    return matched


def apart(node: Node) -> bool:
    """Whether an element is by its kind or name no part of an article.

    Names of the page and its main element say what it has, not what it is, and so do those
    of an article, unless a whole name says that it is a comment or an advert.
    """
    if node.tag in ("#page", "html", "body", "main"):
        return False
    if node.tag == "article":
        return bool(ASIDES.intersection(node.names.lower().split()))
    return node.tag in APART or bool(node.names and _NAMES.search(node.names))


def doubtful(node: Node) -> bool:
    """Whether an element is apart by nothing but names that say how it looks."""
    return node.tag not in APART and node.tag != "article" and apart(node) and not _NAMES.search(_LOOKS.sub("", node.names))


def holders(order: list[Node], wanted: set[int]) -> set[int]:
    """Numbers of the elements that are or hold one of those wanted."""
    out: set[int] = set()
    for node in reversed(order):
        if node.number in wanted or any(c.number in out for c in node.elements()):
            out.add(node.number)
    return out


def _roots(root: Node) -> tuple[list[Node], bool]:
    """Where the main text is: articles, else main elements, else the whole page."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == wanted or wanted == "main" and node.names == "main":
                found.append(node)
            elif not apart(node):
                todo += reversed(node.elements())
        if found:
            return found, True
    return [root], False


def blocks(root: Node, template: set[int] = frozenset(), content: set[int] = frozenset()) -> list[str]:
    """The blocks of main text in page order.

    template: numbers of elements whose own text belongs to the host; it is left out, unless
    an article has no other text. content: elements that stay in spite of their names.
    """
    roots, marked = _roots(root)
    if not marked:
        return _blocks(root, template, content)
    out: list[str] = []
    for article in roots:
        out += _blocks(article, template, content) or _blocks(article, frozenset(), content)
    return out


def _blocks(root: Node, template: set[int], content: set[int]) -> list[str]:
    out: list[str] = []
    pieces: list[str] = []

    def end() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            out.append(text)
        pieces.clear()

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            pieces.append(item)
        elif item is root or item.number in content or not apart(item):
            children = item.elements() if item.number in template else item.children
            if item.tag == "br":
                pieces.append(" ")
            if item.tag in BLOCK or item.tag == "#page":
                end()
                todo.append(None)
            todo += reversed(children)
    end()
    return out


def skeleton(root: Node, depth: int = 4) -> int:
    """A hash of the kinds of elements down to some depth, however often each occurs."""
    out, level = set(), [("", root)]
    for _ in range(depth):
        level = [(f"{path}/{c.label}", c) for path, node in level for c in node.elements()]
        out.update(path for path, _ in level)
    return xxhash.xxh3_64_intdigest("\n".join(sorted(out))) - (1 << 63)


def host_of(url: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))


def _slots(root: Node) -> dict[int, tuple[int, int]]:
    """For the elements with text of their own, hashes of the tags that lead there and of that
    text. What lies below tags that are no part of an article is never asked for."""
    out, todo = {}, [(0, root)]
    while todo:
        path, node = todo.pop()
        text = node.own_text()
        if text:
            out[node.number] = path - (1 << 63), xxhash.xxh3_64_intdigest(text) - (1 << 63)
        todo += [(xxhash.xxh3_64_intdigest(c.tag, path), c) for c in node.elements() if c.tag not in APART]
    return out


def introducing(order: list[Node], template: set[int], content: set[int] = frozenset()) -> set[int]:
    """Numbers of the headings among the template that stand directly before a sibling with
    text that stays: they belong to it, however many pages have them."""
    stays = {n.number for n in order if n.number not in template and n.own_text()}
    for node in reversed(order):
        if node.number in stays and apart(node) and node.number not in content:
            stays.discard(node.number)
    out: set[int] = set()
    for node in reversed(order):  # what lies below comes first
        inside = [c.number in stays and (c.number in content or not apart(c)) for c in node.elements()]
        if any(inside):
            stays.add(node.number)
        last = 0  # the rank of what follows, 7 for other than headings
        for child, has in zip(reversed(node.elements()), reversed(inside)):
            rank = HEADINGS.get(child.tag, 7)
            if not has and child.number in template and rank < last:
                out.add(child.number)
                has = True
                stays.update((child.number, node.number))
            last = rank if has else 0
    return out


def with_outlines(pages: DataFrame) -> DataFrame:
    """The pages with `kind`, the hash of their outline."""

    def outline(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [skeleton(parse(page, 4)) for page in b.column("html").to_pylist()]
        return pa.record_batch([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, "kind"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields]
    return map_rows(pages, outline, ", ".join([*columns, "kind long"]))


def wrappers(pages: DataFrame, share: float = 0.9, least: int = 5) -> DataFrame:
    """(host, kind, model, constant, varied, common) for every outline of a host: a page to align
    its pages with, the numbers of the model's elements whose own text is the same on most
    pages, and of those where it is not, and the (path, text) pairs that the host's pages share.

    An outline of `least` pages has a page of its own as model, another that of the host's
    most frequent outline. All pages that have a model vote on it. An element is judged if
    `least` different pages match it; it is constant if `share` of them have one text there. A
    text is common to a host if it stands below the same tags on `least` pages and on `share` of
    those that have such a path, whatever their outlines. Equal pages vote once; hosts of
    fewer than `least` pages have no model.
    """
    rows = with_outlines(pages.select("host", "html").distinct())
    kinds = rows.groupBy("host", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("html", F.xxhash64("html")).alias("model")
    )
    kinds = saved(kinds, "outlines")
    hosts = kinds.groupBy("host").agg(
        F.sum("n").alias("pages"), F.max_by("kind", F.struct("n", "kind")).alias("main"), F.max_by("model", F.struct("n", "kind")).alias("most")
    )
    own = F.col("n") >= least
    models = saved(
        kinds.join(hosts.where(F.col("pages") >= least), "host").select(
            "host",
            "kind",
            F.when(own, F.col("kind")).otherwise(F.col("main")).alias("of"),
            F.when(own, F.col("model")).otherwise(F.col("most")).alias("model"),
        ),
        "models",
    )

    def vote(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        last, match = None, None
        for host, page, of, model in zip(*(b.column(c).to_pylist() for c in ("host", "html", "of", "model"))):
            if model != last:
                last, match = model, aligner(parse(model))
            own = parse(page)
            order = numbered(own)
            found = _slots(own)
            out += [(host, of, there, found[here][1]) for there, here in match(order).items() if here in found]
            held = set(found.values())
            out += [(host, None, path, text) for path, text in held]
            out += [(host, None, path, None) for path in {path for path, _ in held}]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*out) if out else [[]] * 4
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["host", "of", "node", "text"])

    votes = map_rows(rows.join(models, ["host", "kind"]), vote, "host string, of long, node long, text long")
    counted = saved(votes.groupBy("host", "of", "node", "text").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) | F.col("of").isNotNull()), "votes")
    same = F.col("most") >= share * F.col("all")
    slots = (
        counted.where("of IS NOT NULL")
        .groupBy("host", "of", "node")
        .agg(F.sum("n").alias("all"), F.max("n").alias("most"))
        .where(F.col("all") >= least)
        .groupBy("host", "of")
        .agg(
            F.collect_list(F.when(same, F.col("node"))).alias("constant"),
            F.collect_list(F.when(~same, F.col("node"))).alias("varied"),
        )
    )
    by_path = counted.where("of IS NULL")
    total = by_path.where("text IS NULL").select("host", "node", F.col("n").alias("all"))
    common = (
        by_path.where("text IS NOT NULL")
        .join(total, ["host", "node"])
        .where(F.col("n") >= share * F.col("all"))
        .groupBy("host")
        .agg(F.collect_list(F.struct(F.col("node").alias("path"), "text")).alias("common"))
    )
    none = F.array().cast("array<long>")
    return models.join(slots, ["host", "of"], "left").join(common, "host", "left").select(
        "host",
        "kind",
        "model",
        *[F.coalesce(c, none).alias(c) for c in ("constant", "varied")],
        F.coalesce("common", F.array().cast("array<struct<path:bigint,text:bigint>>")).alias("common"),
    )


def main_text(pages: DataFrame, share: float = 0.9, least: int = 5) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of every page.

    Pages of a host are aligned with the wrapper of their outline; what is constant there, or
    common to the host's pages by path and text, is template and what varies is content, within
    marked articles as elsewhere. A constant heading directly before something that stays is
    content, and so is an article that is constant as a whole. Pages may be of any size, depth
    and number of siblings. Hosts of
    fewer than `least` different pages have no wrapper. Elements that are menus, headers, footers, side columns,
    notices, adverts, forms or comments by their tag, class, id or role are left out with all
    below them. Names that say how an element looks (header, notice, share, search) count only
    where the wrapper has found nothing that varies in it. Blocks are trimmed, white space
    within is one space, character references are decoded; blocks are joined by line
    breaks. A null page is an empty one with empty text; a missing host is the host ''.
    Equal rows give equal rows.
    """
    rows = text_rows(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host")
    )
    models = saved(wrappers(rows, share, least), "wrappers")

    def extract(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        last, match, holding = None, None, set()
        columns = (b.column(c).to_pylist() for c in ("html", "model", "constant", "varied", "common"))
        for page, model, constant, varied, common in zip(*columns):
            own = parse(page)
            order = numbered(own)
            template: set[int] = set()
            content: set[int] = set()
            if common:
                shared = {(x["path"], x["text"]) for x in common}
                template = {n for n, slot in _slots(own).items() if slot in shared}
            if constant or varied and any(map(doubtful, order)):
                if model != last:
                    last, tree = model, parse(model)
                    match, holding = aligner(tree), holders(numbered(tree), set(varied))
                known = set(constant)
                for there, here in match(order).items():
                    if there in known:
                        template.add(here)
                    if there in holding and doubtful(order[here]):
                        content.add(here)
            if template:
                template -= introducing(order, template, content)
            found = blocks(own, template, content)
            texts.append("\n".join(found))
            counts.append(len(found))
        return pa.record_batch(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
            ["page_id", "url", "text", "n_blocks"],
        )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    found = map_rows(with_outlines(rows).join(models, ["host", "kind"], "left"), extract, f"{kinds}, text string, n_blocks long")
    return found.select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks"
    )
