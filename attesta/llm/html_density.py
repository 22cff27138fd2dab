"""Main text of web pages by composite text density.

A page is parsed leniently into a tree. Elements that never hold an article (scripts, navigation,
footers, forms, ...) and elements whose role, id or class says so are left out. For each other node the
composite text density is computed: characters per tag, lowered where the characters are links. A
node's density sum adds up its children's densities; the node with the largest sum is the heart of the
article. The threshold is the smallest density on the way from there to the body; every subtree that
reaches it gives its own node with the largest sum. What they hold is printed, widened to the article
or main element they lie in, block by block.

Each page is judged where it was read; no row moves.

Defined cases: a null or empty page, and one without text, gives an empty text; a cut-off page is
read as far as it goes; repeated rows are judged each; other columns pass through.
"""

import heapq
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table
    caption tbody thead tfoot tr td th ul""".split())
NEVER = frozenset("""nav aside footer form button select option datalist dialog menu head audio video canvas map
    fieldset input label""".split())
#: An open element of the first kind ends where one of the second starts.
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"},
             "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
#: Elements an implied end does not reach through.
WALL = frozenset("table td th ul ol dl div article section main body html blockquote aside nav footer header form figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in an id or class that mark what is not the article.
MARKS = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead banner cookie
    cookies consent gdpr notice notices notification alert alerts warning popup modal overlay newsletter subscribe subscription
    signup ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion share sharing
    social related recommended recommendations comment comments commentlist disqus reply replies respond responses
    widget widgets pagination pager toolbar login search copyright skip legal disclaimer teaser outbrain taboola""".split())
#: Those of readers: never the article, however much they hold.
READERS = frozenset("""comment comments commentlist disqus reply replies respond responses related recommended
    recommendations outbrain taboola cookie cookies consent gdpr""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_LETTERS = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """The tree of a page: parallel lists over nodes in page order, and its text events."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marked = ["html"], [-1], [0]
        self.events = []   # (node, text), or (node, None) where a block starts or ends
        self._parse(source)

    def _parse(self, source):
        stack, at, n = [0], 0, len(source)
        tags, events = self.tag, self.events
        while at < n:
            m = TOKEN.search(source, at)
            if not m:
                events.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                events.append((stack[-1], source[at:m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        if name in BLOCK:
                            events.append((stack[-1], None))
                        del stack[k:]
                        break
                    if tags[stack[k]] in WALL and name not in WALL:
                        break
                continue
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
                if not attributes.endswith("/"):
                    at = end.end() if end else (n if name in ("script", "style") else at)
                continue
            if name in ("html", "body") and len(stack) > 1 and name == "html":
                continue
            for k in range(len(stack) - 1, 0, -1):
                open_ = tags[stack[k]]
                if name in CLOSED_BY.get(open_, ()):
                    events.append((stack[-1], None))
                    del stack[k:]
                    break
                if open_ in WALL:
                    break
            if name in BLOCK:
                events.append((stack[-1], None))
            elif name == "br":
                events.append((stack[-1], " "))
            node = len(tags)
            tags.append(name)
            self.parent.append(stack[-1])
            self.marked.append(_marked(name, attributes))
            if name not in VOID and not attributes.endswith("/"):
                stack.append(node)

    def judge(self, wrappers: int = 0):
        """Density, density sum and whether to keep, for each node.

        An element that is marked, or of a kind that is never the article, is kept if it is a wrapper: if it
        holds an article's element and most of the text, or most of the text that is not linked and no
        readers' part. With ``wrappers`` 1 also a readers' part that holds most may be one; with 2 marks and
        forms are passed over altogether."""
        tags, parent, count = self.tag, self.parent, len(self.tag)
        own = [0] * count
        for node, text in self.events:
            if text:
                own[node] += len(" ".join(text.split()))
        # a marked element that holds the article itself is a wrapper: keep it
        weight, heart, titled = own[:], [False] * count, [False] * count
        linked = [False] * count
        for k in range(1, count):
            linked[k] = linked[parent[k]] or tags[k] == "a"
        prose = [0 if a else c for c, a in zip(own, linked, strict=True)]
        for k in range(count - 1, 0, -1):
            weight[parent[k]] += weight[k]
            prose[parent[k]] += prose[k]
            heart[parent[k]] |= heart[k] or tags[k] in ("article", "main", "h1") and not self.marked[k]
            titled[parent[k]] |= titled[k] or tags[k] in HEADINGS
        kept = [True] * count
        for k in range(1, count):
            inside = kept[parent[k]]
            if inside and tags[k] == "header":
                inside = self._within(k, ("article", "main")) and titled[k] and not self.marked[k]
            elif inside and (self.marked[k] or tags[k] in NEVER):
                open_ = tags[k] in ("form", "fieldset") or tags[k] not in NEVER
                inside = (heart[k] and 2 * weight[k] > weight[0]
                          or open_ and 2 * prose[k] > prose[0] and (wrappers or self.marked[k] != 2)
                          or open_ and wrappers == 2)
            kept[k] = inside
        chars = [c if k else 0 for c, k in zip(own, kept, strict=True)]
        links, inner, link_tags = [0] * count, [0] * count, [0] * count
        for k in range(count):
            if tags[k] == "a" and kept[k]:
                link_tags[k], links[k] = 1, chars[k]
        for k in range(count - 1, 0, -1):
            if kept[k]:
                p = parent[k]
                if tags[k] == "a":
                    links[k] = chars[k]
                chars[p] += chars[k]
                links[p] += links[k]
                inner[p] += inner[k] + 1
                link_tags[p] += link_tags[k]
        body_ratio = links[0] / max(1, chars[0])
        density, total = [0.0] * count, [0.0] * count
        for k in range(count - 1, -1, -1):
            if kept[k] and chars[k]:
                c, t, lc, lt = chars[k], max(1, inner[k]), max(1, links[k]), max(1, link_tags[k])
                base = math.log(c / max(1, c - links[k]) * links[k] + body_ratio * c + math.e)
                density[k] = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / base)
                if k:
                    total[parent[k]] += density[k]
        return kept, density, total, chars, links

    def _within(self, node, names):
        node = self.parent[node]
        while node > 0:
            if self.tag[node] in names:
                return True
            node = self.parent[node]
        return False

    def _common(self, nodes):
        """The lowest node above or equal to all of ``nodes``."""
        heap = [-k for k in set(nodes)]   # parents have smaller numbers than their children
        heapq.heapify(heap)
        while True:
            last = heapq.heappop(heap)
            while heap and heap[0] == last:
                heapq.heappop(heap)
            if not heap:
                return -last
            heapq.heappush(heap, -self.parent[-last])

    def text(self) -> str:
        """The article: by the first of three judgements, each less strict, that leaves any text."""
        return next((t for t in map(self._text, range(3)) if t), "")

    def _text(self, wrappers: int) -> str:
        kept, density, total, chars, links = self.judge(wrappers)
        tags, parent, count = self.tag, self.parent, len(self.tag)
        if not chars[0]:
            return ""
        heart = max(range(count), key=lambda k: (total[k] if kept[k] else -1.0, -k))
        node, threshold = heart, density[heart]
        while node >= 0:
            threshold = min(threshold, density[node])
            node = parent[node]
        # of each subtree that reaches the threshold, the node with the largest sum
        best = list(range(count))
        for k in range(count - 1, 0, -1):
            p = parent[k]
            if kept[k] and total[best[k]] > total[best[p]]:
                best[p] = best[k]
        top = [k for k in range(count) if tags[k] in ("html", "body")]
        marks = {heart} | {best[k] for k in range(1, count)
                           if kept[k] and chars[k] and density[k] >= threshold and k not in top}
        node = self._common(marks)
        if node in top:   # text right below the body, or in several of its children
            roots = marks - set(top)
            if heart in top:
                roots = {k for k in range(1, count) if kept[k] and parent[k] in top and k not in top
                         and 2 * links[k] < max(1, chars[k])}
        else:
            # take in a parent that adds little, and little of it links; and headings before the text
            while parent[node] not in top and 10 * chars[node] >= 8 * chars[parent[node]] and \
                    10 * (links[parent[node]] - links[node]) <= 3 * (chars[parent[node]] - chars[node]):
                node = parent[node]
            roots, up = {node}, node
            while up > 0:
                roots |= {k for k in range(up) if parent[k] == parent[up] and tags[k] in ("h1", "h2") and kept[k]}
                up = parent[up]
        chosen = [k in roots for k in range(count)]
        if heart in top:
            chosen[heart] = not roots
            bare = {k for k in top if kept[k]}   # text that stands in the body itself
        else:
            bare = set()
        for k in list(roots):   # widen to the article or main element
            node, wide = k, k
            while node > 0:
                if tags[node] in ("article", "main"):
                    wide = node
                node = parent[node]
            chosen[wide] = True
        if any(chosen[k] and tags[k] in ("article", "main") for k in range(count)):
            # a page with an article element has its text there
            inside = [False] * count
            for k in range(1, count):
                inside[k] = inside[parent[k]] or tags[k] in ("article", "main")
            if inside[heart]:
                chosen = [c and i for c, i in zip(chosen, inside, strict=True)]
        for k in range(1, count):
            chosen[k] = kept[k] and (chosen[k] or chosen[parent[k]])
        blocks, run = [], []
        for node, text in self.events:
            if text is None:
                if run:
                    blocks.append(run)
                    run = []
            elif chosen[node] or node in bare:
                run.append(text)
        if run:
            blocks.append(run)
        texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
        return "\n".join(t for t in texts if t)


def _marked(name, attributes) -> int:
    """0 for an element without a mark, 2 for one that is hidden or a part of readers, 1 for other marks."""
    if not attributes or name in ("html", "body"):
        return 0
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            return 2
        if key == "role" and value.lower() in ROLES:
            found = max(found, 1)
        if key in ("class", "id"):
            for word in value.split():
                parts = NOT_LETTERS.split(word) if word.islower() else NOT_LETTERS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower())
                # "no-comments" or "has-sidebar" tell about the page, not about this element
                if parts[0] not in ("no", "has", "with", "without", "is", "hide", "show") and not MARKS.isdisjoint(parts):
                    found = max(found, 1 if READERS.isdisjoint(parts) else 2)
    return found


def main_text(source: str | None) -> str:
    """The article of one page."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, source: str = "html", out: str = "extracted") -> DataFrame:
    """``pages`` with a struct ``out`` (with underscores behind it where a column has that name): the main
    text and its number of code points."""
    out = free_name(out, pages)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StructType([
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))])
    kind = pa.struct([("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            found = pa.array([{"text": t, "n_chars": len(t)} for t in texts], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return pages.mapInArrow(run, schema)
