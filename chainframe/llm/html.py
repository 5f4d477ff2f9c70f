"""Main text of web pages, by a recurrent labeller of blocks.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is a vector of
hashed words of its tag path (names, classes, ids), hashed words of its text, and a few measures. A
bidirectional LSTM in numpy reads the blocks of a whole page and labels each one from all of them.

There are no labels for pages. The labeller is fitted on a bounded sample of pages whose main part is marked
by ``article`` or ``main``, and on rearranged ones: the same texts in other markup, with page furniture around and inside.
"""

from __future__ import annotations

import html
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm import common

#: Pages that the labeller is fitted on, at most.
FIT_PAGES = 200
PATH_BINS, WORD_BINS, MEASURES = 192, 32, 8
WIDTH = PATH_BINS + WORD_BINS + MEASURES
HIDDEN = 16
#: Blocks of pages that are labelled together.
TOGETHER = 8192
#: Words from which on a block's words weigh less each, so that long blocks stay in the range of short ones.
FULL_WEIGHT = 40

# Names of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATHS = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = ("script", "style", "title", "noscript", "template", "svg", "iframe", "annotation", "annotation-xml")
RAW = frozenset(("script", "style", "title", "iframe"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# a tag ends at the next tag too, so that what is never closed isn't read to the end of the page again and again
_MARK = re.compile(r"<!--|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:\"[^\"<>]*+\"|'[^'<>]*+'|\"[^\"]*+\"|'[^']*+'|[^<>])*+)(?:>|(?=<)|$)|<[!?][^<>]*+>?|</[^<>]*+>?")
_SHORT_COMMENT = re.compile(r"-?>")  # <!--> and <!---> are whole
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


#: Elements that a list item, cell or paragraph outside them can't be closed from within.
BARRIERS = frozenset("ul ol table dl div article section".split())
MAIN_TAGS = frozenset(("article", "main"))
BAD_NAMES = frozenset("nav header footer aside form ad ads comments comment sidebar menu".split())


@dataclass
class Block:
    """A leaf's text; which bins the words of its tag path fall into; characters in links; whether the path says that it is main text."""

    text: str
    path: np.ndarray
    linked: int
    main: bool = False


class _Open:
    """The elements that are open at a place of a page. Every step takes the time of what it opens or closes, however deep it stands."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list[int], list[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.bins, self.marks = array("i", [0]) * PATH_BINS, dict.fromkeys(MAIN_TAGS | BAD_NAMES, 0)

    def push(self, name: str, rest: str) -> None:
        at, (bins, marks) = len(self.stack), _TAGS[f"{name} {rest}"]
        self.stack.append((name, bins, marks))
        self.places.setdefault(name, []).append(at)
        if name in BARRIERS:
            self.barriers.append(at)
        for b in bins:
            self.bins[b] += 1
        for m in marks:
            self.marks[m] += 1

    def pop(self) -> None:
        name, bins, marks = self.stack.pop()
        self.places[name].pop()
        if name in BARRIERS:
            self.barriers.pop()
        for b in bins:
            self.bins[b] -= 1
        for m in marks:
            self.marks[m] -= 1

    def close(self, name: str) -> None:
        """Closes the innermost element of the name and all inside it; without one nothing."""
        if places := self.places.get(name):
            at = places[-1]
            while len(self.stack) > at:
                self.pop()

    def close_unless_barred(self, name: str) -> None:
        if (places := self.places.get(name)) and not (self.barriers and self.barriers[-1] > places[-1]):
            self.close(name)

    def path(self) -> np.ndarray:
        return np.frombuffer(self.bins, np.int32) > 0

    def is_main(self) -> bool:
        return any(self.marks[w] for w in MAIN_TAGS) and not any(self.marks[w] for w in BAD_NAMES)


class _Bins(common.Bounded):
    """Word -> its bin."""

    def __init__(self, bins: int):
        super().__init__(8 << 20, 64)
        self.bins = bins

    def __missing__(self, word: str) -> int:
        out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % self.bins
        self.keep(word, out)
        return out


class _Tags(common.Bounded):
    """A start tag's name and attributes -> the bins of its words, and those words that tell main text from the rest."""

    def __missing__(self, tag: str) -> tuple[list[int], list[str]]:
        name, _, rest = tag.partition(" ")
        words = [name, *_names(rest)]
        out = [_PATHS[w] for w in words], [w for w in words if w in MAIN_TAGS or w in BAD_NAMES]
        self.keep(tag, out, 80 * len(words) + 120)
        return out


_PATHS, _WORDS, _TAGS = _Bins(PATH_BINS), _Bins(WORD_BINS), _Tags(8 << 20)


def _names(rest: str) -> list[str]:
    return [p for m in _NAMES.finditer(rest) for p in _PARTS.findall((m[1] or m[2] or m[3] or "").lower())] if "=" in rest else []


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with references decoded and white space folded; in time linear in the page.

    Formulas and objects are read as what stands around them. What a closed UNSEEN element holds is left out, and all that follows an open
    script, style, title, iframe or comment, as in browsers; of any other that is never closed only the start tag is.
    """
    page = page or ""
    out: list[Block] = []
    opened, run = _Open(), []
    linked, at, path, main = 0, 0, opened.path(), False
    endless: set[str] = set()  # unseen elements that nothing closes from here on

    def close():
        nonlocal run, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(Block(text, path, min(linked, len(text)), main))
            run, linked = [], 0

    def text(piece: str):
        nonlocal linked, path, main
        if piece:
            if not run:
                path, main = opened.path(), opened.is_main()
            run.append(piece)
            linked += len(piece) if opened.places.get("a") else 0

    while at < len(page):
        mark = _MARK.search(page, at)
        if not mark:
            text(page[at:])
            break
        text(page[at : mark.start()])
        at = mark.end()
        if mark[0] == "<!--":
            if short := _SHORT_COMMENT.match(page, at):
                at = short.end()
            else:
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
        elif mark["name"]:
            name = mark["name"].lower()
            if name in UNSEEN:
                if not mark["end"] and name not in endless and not (name == "svg" and mark["rest"].endswith("/")):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                    if end:
                        at = end.end()
                    elif name in RAW:
                        at = len(page)
                    else:
                        endless.add(name)
                continue
            if name == "br":
                text(" ")
                continue
            if name not in INLINE and name not in MATHS:
                close()
            if mark["end"]:
                opened.close(name)
            else:
                for shut in CLOSES.get(name, ()) or (("p",) if name in ENDS_P else ()):
                    opened.close_unless_barred(shut)
                if name not in VOID and not mark["rest"].endswith("/"):
                    opened.push(name, mark["rest"])
    close()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """A row for each block, of all its words; a block's words weigh the same each, and 4 together at most."""
    out = np.zeros((len(page), WIDTH), np.float32)
    for i, b in enumerate(page):
        out[i, :PATH_BINS] = b.path
        words = b.text.split(" ")
        bins = np.bincount(list(map(_WORDS.__getitem__, b.text.lower().split(" "))), minlength=WORD_BINS)
        out[i, PATH_BINS : PATH_BINS + WORD_BINS] = 0.1 * min(1, FULL_WEIGHT / len(words)) * bins
        n = len(b.text)
        ends = b.text.count(".") + b.text.count("!") + b.text.count("?")
        out[i, PATH_BINS + WORD_BINS :] = (1, min(np.log1p(n) / 6, 2), b.linked / n, min(len(words) / 50, 2), min(ends / max(1, len(words)) * 5, 2), i / len(page), b.text[-1] in ".!?", "@" in b.text or "©" in b.text)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Labels each step of a sequence from the whole of it. All arrays are (steps, sequences, values)."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.hidden, self.p = hidden, {}
        for way in "fb":
            self.p |= {f"x{way}": rng.normal(0, 0.1, (width, 4 * hidden)), f"h{way}": rng.normal(0, 0.2, (hidden, 4 * hidden)), f"c{way}": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]}
        self.p |= {"o": rng.normal(0, 0.2, 2 * hidden), "s": np.zeros(width), "q": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _way(self, x: np.ndarray, mask: np.ndarray, way: str):
        n = self.hidden
        given = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        trail, out = [], np.zeros((*x.shape[:2], n), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = given[t] + h @ self.p[f"h{way}"]
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c_new = m * (f * c + i * g)
            tanh_c = np.tanh(c_new)
            h_new = m * o * tanh_c
            trail.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = h_new, c_new
            out[t] = h
        return out, trail

    def forward(self, x: np.ndarray, mask: np.ndarray):
        ahead, back = self._way(x, mask, "f"), self._way(x, mask, "b")
        both = np.concatenate([ahead[0], back[0]], 2)
        return both @ self.p["o"] + x @ self.p["s"] + self.p["q"], both, (ahead[1], back[1])

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        z, both, trails = self.forward(x, mask)
        d = (_sigmoid(z) - y) * mask / mask.sum()
        grad = {"o": np.einsum("tb,tbh->h", d, both), "s": np.einsum("tb,tbf->f", d, x), "q": np.array([d.sum()])}
        n = self.hidden
        for way, trail, part in (("f", trails[0], self.p["o"][:n]), ("b", trails[1], self.p["o"][n:])):
            g_h = np.zeros_like(self.p[f"h{way}"])
            d_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            dh, dc = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
            for t, h, c, i, f, o, g, tanh_c, m in reversed(trail):
                dh_t = (dh + d[t][:, None] * part) * m
                dc_t = (dc * m) + dh_t * o * (1 - tanh_c**2)
                dz = np.concatenate([dc_t * g * i * (1 - i), dc_t * c * f * (1 - f), dh_t * tanh_c * o * (1 - o), dc_t * i * (1 - g**2)], 1)
                d_all[t] = dz
                g_h += h.T @ dz
                dh, dc = dz @ self.p[f"h{way}"].T, dc_t * f
            grad |= {f"h{way}": g_h, f"x{way}": np.einsum("tbf,tbz->fz", x, d_all, optimize=True), f"c{way}": d_all.sum((0, 1))}
        return grad


def together(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages as one padded array and its mask."""
    x = np.zeros((max(map(len, pages)), len(pages), WIDTH), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for i, page in enumerate(pages):
        x[: len(page), i], mask[: len(page), i] = page, 1
    return x, mask


def label(model: BiLstm, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For each page which blocks belong to the main text; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    while order:
        n = max(1, TOGETHER // len(pages[order[-1]]))
        some, order = order[-n:], order[:-n]
        x, mask = together([pages[i] for i in some])
        z = model.forward(x, mask)[0]
        for j, i in enumerate(some):
            out[i] = z[: len(pages[i]), j] > 0
    return out


# How pages name their parts.
MAIN_NAMES = "content post entry story body text articlebody main page single prose".split()
BAD_TAGS = {"nav": "menu nav navigation links breadcrumb", "header": "header banner masthead top logo", "footer": "footer copyright bottom legal", "aside": "sidebar related widget side promo", "form": "search login subscribe newsletter signup", "div": "ad ads advert sponsor notice cookie consent alert popup modal share social comments comment reply disqus related sidebar menu banner footer header newsletter promo", "section": "comments comment responses related sponsor newsletter notice", "ul": "menu tags share comments links"}
SHORT = "Home About us Contact Log in Sign up Subscribe Share Search Menu Reply Read more Accept cookies Privacy policy Terms Next Previous".split(" ")


def _furniture(rng: np.random.Generator, texts: list[str]) -> str:
    tag = rng.choice(list(BAD_TAGS))
    word = rng.choice(BAD_TAGS[tag].split())
    name = rng.choice([f' class="{word}"', f' id="{word}"', f' class="{word}-{rng.choice(["box", "area", "wrap", "list", "item"])}"', "" if tag not in ("div", "section", "ul") else f' class="{word}"'])
    short = lambda: " ".join(rng.choice(SHORT, rng.integers(1, 4)))
    long = lambda: str(rng.choice(texts))[: rng.integers(20, 400)]
    kind = rng.integers(0, 4)
    if kind == 0:
        body = "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(rng.integers(2, 7))) + "</ul>"
    elif kind == 1:
        body = "".join(f"<p>{long()}</p>" for _ in range(rng.integers(1, 4)))
    elif kind == 2:
        body = f"<div><span>{short()}</span> {long()}</div>" * int(rng.integers(1, 3))
    else:
        body = f"{long()}"
    return f"<{tag}{name}>{body}</{tag}>"


def rearranged(rng: np.random.Generator, main: list[str], texts: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page with the texts ``main`` in other markup, and the label of each block."""
    wrap = rng.integers(0, 4)
    name = rng.choice(MAIN_NAMES)
    begin, end = (("<article>", "</article>"), ("<main>", "</main>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}"><article class="{rng.choice(MAIN_NAMES)}">', "</article></div>"))[wrap]
    mark, body = "", []
    for i, text in enumerate(main):
        tag = "h1" if i == 0 else rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "div", "pre", "td"], p=[0.2, 0.2, 0.2, 0.1, 0.08, 0.07, 0.05, 0.04, 0.03, 0.03])
        inner = html.escape(text)
        if rng.random() < 0.2:
            cut = len(inner) // 3
            inner = f'<a href="/y">{inner[:cut]}</a>{inner[cut:]}' if "&" not in inner else f"<em>{inner}</em>"
        body.append({"li": f"<ul><li>{mark}{inner}</li></ul>", "td": f"<table><tr><td>{mark}{inner}</td></tr></table>"}.get(tag, f"<{tag}>{mark}{inner}</{tag}>"))
        if rng.random() < 0.12:
            body.append(_furniture(rng, texts))
    around = lambda: "".join(_furniture(rng, texts) for _ in range(rng.integers(0, 5)))
    page = blocks(f"<html><body>{around()}{begin}{''.join(body)}{end}{around()}</body></html>")
    label = np.array([mark in b.text for b in page], np.float32)
    for b in page:
        b.text = b.text.replace(mark, "").strip() or "."
    return page, label


def _gradients(model: BiLstm, data: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The mean gradients over all blocks; pages that would pad to more than TOGETHER blocks are read in parts."""
    parts: list[list] = []
    for d in sorted(data, key=lambda d: len(d[0])):
        if not parts or (len(parts[-1]) + 1) * len(d[0]) > TOGETHER:
            parts.append([])
        parts[-1].append(d)
    total, n = {}, sum(len(d[0]) for d in data)
    for part in parts:
        x, mask = together([d[0] for d in part])
        y = np.zeros(mask.shape, np.float32)
        for i, (_, label_of) in enumerate(part):
            y[: len(label_of), i] = label_of
        for k, g in model.gradients(x, y, mask).items():
            total[k] = total.get(k, 0) + g * (mask.sum() / n)
    return total


def fit_pages(pages: list[str], seed: int = 4, variants: int = 2, epochs: int = 6) -> BiLstm:
    """Fits the labeller on marked pages as they are and on ``variants`` rearranged ones for each."""
    rng, model = np.random.default_rng(seed), BiLstm()
    data, texts, mains = [], [], []
    for page in pages:
        found = blocks(page)
        good = [b.main for b in found]
        texts += [b.text for b, g in zip(found, good, strict=True) if not g]
        mains.append([b.text for b, g in zip(found, good, strict=True) if g])
        if any(good):
            data.append((vectors(found), np.array(good, np.float32)))
    mains = [m for m in mains if m] or [["Text of a page that says something. It goes on."]]
    texts = (texts + [t for m in mains[:50] for t in m[1:3]]) or ["Menu"]
    while len(data) < max(400, (1 + variants) * len(pages)):
        page, y = rearranged(rng, list(mains[rng.integers(len(mains))]), texts)
        if len(page):
            x = vectors(page)
            x[:, :PATH_BINS] *= rng.random((1, PATH_BINS)) > 0.08
            data.append((x, y))
    m1, m2, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 24):
            some = [data[i] for i in order[at : at + 24]]
            step += 1
            for k, g in _gradients(model, some).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def sample(df: DataFrame, key: str = "page_id", page: str = "html") -> list[str]:
    """The FIT_PAGES pages with the lowest hash of the id, pages of one hash by their html; all of them if there are fewer."""
    parts = 1_000_000
    rows = df.where(F.col(page).isNotNull()).select(F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).alias("_hash"), F.col(page).alias("_page"))
    n = rows.count()
    share = min(parts, int(parts * FIT_PAGES * 1.5 / max(1, n)) + 1)
    lowest = lambda some: [r[0] for r in some.orderBy("_hash", "_page").limit(FIT_PAGES).select("_page").collect()]
    found = lowest(rows.where(F.col("_hash") < share))
    return found if len(found) == min(n, FIT_PAGES) else lowest(rows)  # ids that repeat or are null can leave too few below the share


def fit(df: DataFrame, key: str = "page_id", page: str = "html") -> BiLstm:
    """Fits on at most FIT_PAGES pages of any length; their whole html comes to the driver. The same table gives the same model, however its files lie."""
    pages = sorted(sample(df, key, page))
    with common.one_thread():
        return fit_pages(pages)


def extract(df: DataFrame, model: BiLstm, page: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text to the rows of df; a null or empty page, or one without main text, has an empty one.

    Blocks are joined by one line feed in page order; nothing else is dropped or cut. Whole pages are read, in time linear in
    their length. Repeated rows get equal texts, an empty table an empty result; a column named as ``out`` is replaced, others stay
    whatever their names. No shuffle; a worker holds 256 pages.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    others = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in others])
    at, struct = others.index(page), common.T.StructType([*rows.schema.fields, common.T.StructField(out, common.T.StringType())])

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 256):
                found = [blocks(x) for x in part.column(at).to_pylist()]
                good = label(sent.value, [vectors(x) for x in found])
                text = ["\n".join(b.text for b, g in zip(x, y, strict=True) if g) for x, y in zip(found, good, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*others, out])

    return rows.mapInArrow(run, struct)


def extract_pages(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page by a labeller fitted on the table itself; without any page it knows only made-up ones."""
    out = extract(df.select("page_id", "url", "html"), fit(df))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
