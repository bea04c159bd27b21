"""HTML extraction by layout-aware rendering: a tree with implied tags and visibility rules, written out as text."""

from __future__ import annotations

import html
import re
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import chunks, text_rows, without

OUT = ("rendered", "n_blocks")

# Fixed values of the HTML standard: kinds of elements and the end tags that a start tag implies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object embed svg math audio video canvas datalist title meta link noframes noembed rp".split())
#: Inputs whose value is shown.
SHOWN_INPUT = frozenset("text search tel url email number date month week time datetime-local submit button reset".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section summary table ul".split()
)
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol pre table ul menu dir".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "optgroup": ("option", "optgroup"),
    "tr": ("td", "th", "tr"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "thead": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"),
    "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"),
    "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"),
}
#: An implied end tag looks no further up than to these.
SCOPE = {
    "li": frozenset(("ul", "ol", "menu", "dir", "td", "th", "table", "body")),
    "dt": frozenset(("dl", "td", "th", "table", "body")),
    "dd": frozenset(("dl", "td", "th", "table", "body")),
    "option": frozenset(("select", "datalist", "body")),
    "optgroup": frozenset(("select", "body")),
}
TABLE_SCOPE = frozenset(("table", "body"))
#: Elements that hold nothing but parts of a table, and the parts, each with those it may stand in.
TABLE_PARTS = frozenset("table thead tbody tfoot tr colgroup".split())
PART_OF = {"tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr", "table", "thead", "tbody", "tfoot"), "col": ("colgroup", "table")}
PART_OF |= {"th": PART_OF["td"], **dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",))}
IN_HEAD = frozenset("title meta link style script noscript base template basefont bgsound noframes".split())
P_SCOPE = frozenset(("td", "th", "caption", "table", "button", "body", "object"))

#: A quote opens a value right after the sign of equality alone; in names and in values without quotes it is a character.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?|'[^']*+'?|[^\s>\"'][^\s>]*+)?)*+)(?:>|$)", re.S)
ATTR = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+)))?")
STYLE = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMPOUND = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
#: Elements that are open at once, at most; deeper ones become siblings, as in browsers.
DEEPEST = 512
#: A wider cell doesn't set the width of its column, so that one long cell doesn't pad every row.
WIDEST = 200
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "display", "outer", "tag", "visibility")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []
        self.display = self.visibility = self.outer = None


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def build(source: str) -> Node:
    """The element tree: start tags imply the end tags that the standard names, end tags without a start are ignored.

    A head ends at what can't stand in it, a cell outside a row gets one, and what can't stand in a table goes before it.
    """
    root = Node("body", {})
    root.outer = Node("html", {})
    stack = [root]

    def close(tags: tuple[str, ...], scope: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    def table_at() -> int:
        """The place of the innermost open table in the stack, or 0."""
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "table"), 0)

    def add(child: Node | str) -> None:
        i = table_at() if stack[-1].tag in TABLE_PARTS and (child.strip(" \t\r\n\f") if isinstance(child, str) else child.tag not in PART_OF) else 0
        if not i:
            stack[-1].children.append(child)
            return
        above = stack[i - 1].children
        j = next(j for j in range(len(above) - 1, -1, -1) if above[j] is stack[i])
        above.insert(j, child)

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        begin = m.start() if m else size
        if begin > at:
            text = html.unescape(source[at:begin])
            if stack[-1].tag == "head" and text.strip(" \t\r\n\f"):
                stack.pop()
            add(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                add(Node("p", {}))
            elif tag not in ("html", "body"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                        break
            continue
        if tag == "body":
            close(("head",), frozenset())
        if tag in ("html", "body"):
            own = root if tag == "body" else root.outer
            own.attrs = attributes(m[3]) | own.attrs  # the first start tag's attributes count
        if tag in ("html", "body") or tag == "head" and (len(stack) > 1 or any(not isinstance(c, str) or c.strip() for c in root.children)):
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in CLOSES_P:
            close(("p",), P_SCOPE)
        if tag in CLOSES:
            for implied in CLOSES[tag]:
                close((implied,), SCOPE.get(tag, TABLE_SCOPE))
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        if tag in PART_OF and (i := table_at()):
            while len(stack) > i + 1 and stack[-1].tag not in PART_OF[tag]:
                stack.pop()
            if tag in ("td", "th") and stack[-1].tag != "tr":
                row = Node("tr", {})
                add(row)
                stack.append(row)
        node = Node(tag, attributes(m[3]) if m[3].strip(" \t\r\n/") else {})
        add(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            body = source[at : end.start() if end else size]
            if tag in ("textarea", "title"):
                body = html.unescape(body)
            node.children.append(body)
            at = end.end() if end else size
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


def declared(text: str) -> list[tuple[str, str, bool]]:
    """The display and visibility declarations of a style: (name, value, important)."""
    return [(m[1].lower(), m[2].lower(), bool(m[3])) for m in STYLE.finditer(text)]


def sheet_rules(css: str) -> list[tuple]:
    """(compounds, declarations) of a sheet's rules about display or visibility.

    Compounds of tag, classes and id are known, alone, below each other or right below (``>``); rules with other
    selectors and blocks for other media than the screen are left out. Compounds come as (tag, classes, ids, whether
    the one before must stand right above).
    """
    css, rules, at = re.sub(r"/\*.*?(?:\*/|$)", " ", css, flags=re.S), [], 0
    while (begin := css.find("{", at)) >= 0:
        prelude = re.split("[;}]", css[at:begin])[-1].strip()
        if prelude.startswith("@"):
            if re.fullmatch(r"@media\s+(?:only\s+)?(?:screen|all)", prelude, re.I):
                at = begin + 1
                continue
            depth, at = 1, begin + 1
            while depth and (m := re.compile("[{}]").search(css, at)):
                depth, at = depth + (1 if m[0] == "{" else -1), m.end()
            if depth:
                break
            continue
        end = css.find("}", begin)
        end = len(css) if end < 0 else end
        if found := declared(css[begin + 1 : end]):
            for selector in prelude.split(","):
                words = selector.replace(">", " > ").split()
                parts = [(COMPOUND.match(x), i > 0 and words[i - 1] == ">") for i, x in enumerate(words) if x != ">"]
                if parts and all(m for m, _ in parts) and words[0] != ">" and words[-1] != ">":
                    compounds = [((m[1] or "*").lower(), frozenset(re.findall(r"\.([\w-]+)", m[2])), frozenset(re.findall(r"#([\w-]+)", m[2])), right) for m, right in parts]
                    rules.append((compounds, found))
        at = end + 1
    return rules


def fits(node: Node, compound: tuple) -> bool:
    tag, classes, ids, _ = compound
    return tag in ("*", node.tag) and (not classes or classes <= set(node.attrs.get("class", "").split())) and (not ids or ids == {node.attrs.get("id", "")})


def stands(above: tuple | None, compounds: list[tuple], last: int) -> bool:
    """Whether the compounds before ``last`` fit elements above: some for each, or the one right above where it says so."""
    if last == 0:
        return True
    if compounds[last][3]:
        return above is not None and fits(above[0], compounds[last - 1]) and stands(above[1], compounds, last - 1)
    while above is not None:
        if fits(above[0], compounds[last - 1]):
            if stands(above[1], compounds, last - 1):
                return True
            if not any(c[3] for c in compounds[:last]):  # the nearest fit leaves the others most to choose from
                return False
        above = above[1]
    return False


def styled(root: Node) -> None:
    """Gives nodes the display and visibility that sheets and inline styles declare for them; of several the strongest."""
    rules, stack = [], [(root, ())]
    while stack:  # sheets first, wherever they stand
        node, _ = stack.pop()
        if node.tag == "style":
            rules += sheet_rules("".join(c for c in node.children if isinstance(c, str)))
        stack += [(c, ()) for c in reversed(node.children) if isinstance(c, Node)]
    by: dict[tuple[str, str], list[tuple]] = {}  # rules by an id, a class or the tag that the last compound asks for
    for order, (compounds, found) in enumerate(rules):
        tag, classes, ids, _ = compounds[-1]
        key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
        by.setdefault(key, []).append((order, compounds, found))
    stack = [(root.outer, None)] if root.outer else [(root, None)]
    while stack:
        node, above = stack.pop()
        best: dict[str, tuple] = {}
        named = [("#", node.attrs.get("id", "")), ("", node.tag), ("", "*"), *((".", x) for x in set(node.attrs.get("class", "").split()))]
        for order, compounds, found in (rule for key in named for rule in by.get(key, ())) if by else ():
            if fits(node, compounds[-1]) and stands(above, compounds, len(compounds) - 1):
                weight = tuple(sum(len(c[i]) for c in compounds) for i in (2, 1)) + (sum(c[0] != "*" for c in compounds), order)
                for name, value, important in found:
                    best[name] = max(best.get(name, ((),)), ((important, 0, *weight), value))
        for name, value, important in declared(node.attrs.get("style", "")):
            best[name] = max(best.get(name, ((),)), ((important, 1), value))
        if "display" in best:
            node.display = best["display"][1]
        if "visibility" in best:
            node.visibility = best["visibility"][1]
        chain = (node, above) if rules else None
        if node is root.outer:
            stack.append((root, chain))
        stack += [(c, chain) for c in node.children if isinstance(c, Node)]
    if root.outer and hidden(root.outer):
        root.display = "none"
    if root.outer and root.visibility in (None, "inherit"):
        root.visibility = root.outer.visibility


def hidden(node: Node) -> bool:
    """No box: elements of kinds without one, display none, the hidden attribute or a closed dialog unless a style shows it."""
    if node.tag in HIDDEN or node.display == "none":
        return True
    return node.display is None and ("hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs)


def seen(node: Node, shown: bool) -> bool:
    """Whether the node's own text is seen; visibility is inherited, and may be set again below a hidden element."""
    return shown if node.visibility in (None, "inherit") else node.visibility not in ("hidden", "collapse")


def select_text(node: Node, out: Lines, shown: bool) -> None:
    """What a closed list shows, the selected option or the first; an open one (multiple, or of some size) shows all."""
    options: list[Node] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node) and not hidden(c):
                if c.tag == "option":
                    options.append(c)
                else:
                    walk(c)

    walk(node)
    size = node.attrs.get("size", "")
    if "multiple" not in node.attrs and not (size.isascii() and size.isdigit() and size.strip("0") not in ("", "1")):
        options = [o for o in options if "selected" in o.attrs][-1:] or options[:1]
    for o in options:
        out.text(" ")
        for c in o.children:
            render(c, out, seen(o, shown))
        out.text(" ")


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Output under way: lines, pending space within a line, blank lines owed between blocks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line, self.space, self.owed, self.blocks = "", False, 0, 0
        self.prefix: list[str] = []
        self.first: str | None = None

    def text(self, text: str) -> None:
        body = SPACE.sub(" ", text)
        core = body.strip(" ")
        if core:
            self.put((" " if (self.space or body[0] == " ") and self.line else "") + core)
            self.space = body[-1] == " "
        elif body:
            self.space = True

    def put(self, text: str, exact: bool = False) -> None:
        if not self.line:
            if self.owed and self.done:
                self.done += [""] * (self.owed - 1)
            self.owed = 0
            lead = "".join(self.prefix)
            if self.first is not None:
                lead, self.first = lead[: len(lead) - len(self.first)] + self.first if len(lead) >= len(self.first) else self.first, None
            self.line = lead + (text if exact else text.lstrip(" "))
        else:
            self.line += text

    def flush(self) -> None:
        if self.line:
            self.done.append(self.line.rstrip(" "))
            self.blocks += 1
        self.line, self.space = "", False

    def gap(self, lines: int) -> None:
        self.flush()
        self.owed = max(self.owed, lines)

    def whole(self, lines: list[str]) -> None:
        """Lines that stay as they are."""
        self.flush()
        for text in lines:
            self.put(text or " ", exact=True)
            if not text.strip():
                self.line = ""
                self.done.append("")
            self.flush()


def render_table(node: Node, out: Lines, shown: bool) -> None:
    """Rows of cells padded to the width of their column; spanned columns and rows stay empty, cell text is on one line.

    A column is as wide as its widest cell of at most ``WIDEST``; columns without text take no room.
    """
    rows: list[list[str]] = []
    caption: list[tuple[Node, bool]] = []
    below: dict[int, int] = {}  # columns that cells from above still take, and for how many rows

    def number(cell: Node, name: str) -> int:
        n = cell.attrs.get(name, "1")
        return int(n) if n.isascii() and n.isdigit() and len(n) < 9 else 1

    def walk(n: Node, shown: bool) -> None:
        below.clear()  # no cell reaches out of its section
        for c in n.children:
            if isinstance(c, str) or hidden(c):
                continue
            own = seen(c, shown)
            if c.tag == "tr":
                cells: list[str] = []
                for cell in c.children:
                    if isinstance(cell, Node) and not hidden(cell):
                        inner = Lines()
                        for x in cell.children if cell.tag in ("td", "th") else [cell]:
                            render(x, inner, seen(cell, own))
                        inner.flush()
                        while below.get(len(cells), 0):
                            cells.append("")
                        at, wide, high = len(cells), min(max(1, number(cell, "colspan")), 1000), number(cell, "rowspan") or 1 << 30
                        cells += [" ".join(x for x in inner.done if x)] + [""] * (wide - 1)
                        if high > 1:
                            below.update(dict.fromkeys(range(at, at + wide), high))
                for j in [*below]:
                    below[j] -= 1
                    if not below[j]:
                        del below[j]
                rows.append(cells)
            elif c.tag == "caption":
                caption.append((c, shown))
            else:
                walk(c, own)

    walk(node, shown)
    out.gap(2)
    for c, own in caption:
        render(c, out, own, as_block=True)
    columns = max((len(r) for r in rows), default=0)
    widths = [-1] * columns
    for r in rows:
        for j, c in enumerate(r):
            if c:
                n = width(c)
                widths[j] = max(widths[j], n if n <= WIDEST else 0)
    filled = [j for j in range(columns) if widths[j] >= 0]
    lines = ("  ".join(r[j] + " " * (widths[j] - width(r[j])) for j in filled if j < len(r)).rstrip() for r in rows if any(r))
    out.whole(list(lines))
    out.gap(2)


def render(node, out: Lines, shown: bool = True, as_block: bool = False, marker: str | None = None) -> None:
    if isinstance(node, str):
        if shown:
            out.text(node)
        return
    if hidden(node):
        return
    tag, shown = node.tag, seen(node, shown)
    if tag == "br":
        if out.line:
            out.flush()
        else:
            out.owed = max(out.owed, 2)
        return
    if tag == "hr":
        out.gap(2)
        return
    if tag == "img":
        return
    if tag == "input":
        if shown and node.attrs.get("type", "text").lower() in SHOWN_INPUT:
            out.text(node.attrs.get("value", ""))
        return
    if tag == "select":
        select_text(node, out, shown)
        return
    if tag == "table":
        render_table(node, out, shown)
        return
    if tag == "pre":
        out.gap(2)
        text = "".join(plain(c, shown) for c in node.children)
        out.whole(text.removeprefix("\n").rstrip("\n").replace("\r\n", "\n").split("\n"))
        out.gap(2)
        return
    if tag == "li":
        out.flush()
        mark = marker or "- "
        out.prefix.append(" " * len(mark))
        out.first = mark
        for c in node.children:
            render(c, out, shown)
        out.flush()
        out.prefix.pop()
        out.first = None
        return
    if tag in ("ul", "ol", "menu", "dir"):
        nested = bool(out.prefix)
        out.gap(1 if nested else 2)
        start = node.attrs.get("start", "1")
        n = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
        for c in node.children:
            if isinstance(c, Node) and c.tag == "li":
                value = c.attrs.get("value", "")
                n = int(value) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", value) else n
                if not hidden(c):
                    render(c, out, shown, marker=f"{n}. " if tag == "ol" else "- ")
                n += 1
            else:
                render(c, out, shown)
        out.gap(1 if nested else 2)
        return
    children = node.children
    if tag == "details" and "open" not in node.attrs:  # closed: its first summary alone
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    block = as_block or tag in BLOCK
    space = 2 if tag in SPACED else 1
    if block:
        out.gap(space)
    if tag in ("blockquote", "dd"):
        out.prefix.append("  ")
    for c in children:
        render(c, out, shown)
    if block:
        out.gap(space)
    if tag in ("blockquote", "dd"):
        out.prefix.pop()


def plain(node, shown: bool = True) -> str:
    if isinstance(node, str):
        return node if shown else ""
    if hidden(node):
        return ""
    return "\n" if node.tag == "br" else "".join(plain(c, seen(node, shown)) for c in node.children)


def page_text(source: str | None) -> tuple[str, int]:
    """(text, number of its lines that aren't blank) of a page."""
    if not source:
        return "", 0
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEEPEST))
    out, root = Lines(), build(source.replace("\0", ""))
    styled(root)
    render(root, out)
    out.flush()
    return "\n".join(out.done), out.blocks


def renderer(at: int, n: int):
    """A mapInArrow function: the first ``n`` columns, and the rendered page of column ``at``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in chunks(batch.column(at)):
                part = batch.slice(start, stop - start)
                got = [page_text(x.as_py()) for x in part.column(at)]
                columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *columns], [*part.schema.names[:n], *OUT])

    return run


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with rendered, all visible text in its layout, and n_blocks, the number of its lines.

    A tree is built with the end tags that start tags imply. Hidden elements give nothing: by kind, by the hidden
    attribute, by inline styles or style sheets (rules on tags, classes and ids), closed details but for their summary;
    an element that is visible again below one of hidden visibility is shown. Fields show their value, lists their
    selected option. Blocks stand on lines of their own, with a blank line around paragraphs, headings, lists and tables;
    list items have marks or numbers and hanging indents; preformatted text keeps its lines. Table cells are padded to
    the width of their column, which cells beyond ``WIDEST`` don't set, so the output grows with the page. Elements more
    than ``DEEPEST`` deep become siblings; their text stays. A null or empty page gives an empty text. Pages are
    independent of each other, so ties, repeated rows and empty tables need no care. Input columns named like an output
    column are replaced. ``keep`` names the columns to return besides (default: all).
    """
    pages = without(pages, [c for c in OUT if c != html_col])
    names = pages.columns if keep is None else keep
    rows, at, schema = text_rows(pages, names, html_col)
    return rows.mapInArrow(renderer(at, len(names)), f"{schema}, rendered string, n_blocks long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), keep=["page_id"])
