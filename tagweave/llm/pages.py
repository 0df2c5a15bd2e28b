"""The main text of web pages by a recurrent block labeller.

A page is cut into blocks, the text between two tags that part blocks.  A block's vector is made of the hashed
names on its tag path (elements, classes, ids, roles), its hashed words and a few measures.  A bidirectional LSTM in numpy reads
the whole sequence of a page's blocks and labels each as main text or not, so a label rests on the whole page.

The labeller learns from pages it invents (``invented_page``): parts in many orders and under many names, with invented words
of any length, broken tags, and pages without any telling name.  Nothing is learned from the pages to be
read.  Training takes a few seconds on the driver and is the same every time.

Nulls: a null or empty page, and one of tags alone, has an empty text.  Pages are read whole.  Repeated rows and rows
without id are read like any other.  An empty table gives an empty one.
"""

import html as entities
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import page_values as V
from tagweave.llm.common import by_batch

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S
)
NAMED = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PARTS = re.compile("[a-z0-9]+")
PATH_SIZE, WORD_SIZE, MEASURES = 256, 32, 5


@dataclass(frozen=True, slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: float  # share of its characters inside links


@lru_cache(4096)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's own names: its tag, its class, id and role words, and these joined."""
    words = [m for named in NAMED.findall(attributes) for value in named if value for m in value.lower().split()]
    parts = [p for w in words for p in NAME_PARTS.findall(w)]
    return (tag, *(f".{w}" for w in words), *(f"-{p}" for p in parts))


def _ends(tag: str, html: str) -> dict[int, int]:
    """From the end of each start tag of a kind to the end of its own end tag, where it has one; elements may be nested."""
    found: dict[int, int] = {}
    open_at: list[int] = []
    for match in TAG.finditer(html):
        name = match[2] or match[5]
        if name is None or name.lower() != tag:
            continue
        if match[1] or match[4]:
            if open_at:
                found[open_at.pop()] = match.end()
        elif not (match[3] or match[6] or "").endswith("/"):
            open_at.append(match.end())
    return found


def blocks_of(html: str) -> list[Block]:
    """The blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = in_link = at = 0
    path: tuple[str, ...] | None = None

    def flush() -> None:
        nonlocal linked, path
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                if path is None:
                    names = [n for _, own in stack for n in own]
                    last = [f"<{tag}" for tag, _ in stack[-2:]]
                    path = (*names, *last)
                found.append(Block(line, path, min(1.0, linked / len(line))))
            text.clear()
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal path
        del stack[depth:]
        path = None

    n = len(html)
    ends: dict[str, dict[int, int]] = {}
    while at < n:
        match = TAG.search(html, at)
        upto = match.start() if match else n
        if upto > at:
            text.append(html[at:upto])
            if in_link:
                linked += upto - at
        if match is None:
            break
        at = match.end()
        slash, tag, attributes = match[1], match[2], match[3]
        if tag is None:
            slash, tag, attributes = match[4], match[5], match[6]
            if tag is None:
                continue
        tag = tag.lower()
        if tag in V.SILENT:
            if not slash and not attributes.endswith("/"):
                if tag in V.RAW:
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else n
                else:
                    if tag not in ends:
                        ends[tag] = _ends(tag, html)
                    at = ends[tag].get(at, at)  # without an end tag it holds nothing
            if tag != "svg" and tag != "math":
                flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in V.INLINE:
            if tag == "a":
                in_link = 0 if slash else 1
            continue
        flush()
        in_link = 0
        if tag in V.VOID:
            continue
        if slash:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
            continue
        if stack and stack[-1][0] == "p":
            close_to(len(stack) - 1)
        if tag in V.CLOSES:
            ends, bounds = V.CLOSES[tag]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in bounds.split():
                    break
                if stack[depth][0] in ends.split():
                    close_to(depth)
                    break
        stack.append((tag, _names(tag, attributes)))
        path = None
    flush()
    return found


# --- vectors ----------------------------------------------------------------------


@lru_cache(20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    x = np.zeros(PATH_SIZE, np.float32)
    for name in path:
        x[zlib.crc32(name.encode()) % PATH_SIZE] = 1
    return x


@lru_cache(50_000)
def _word_slot(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_SIZE


def rest_vector(block: Block, place: int, of: int) -> np.ndarray:
    """Hashed words, as shares, and measures: length, links, capitals, place."""
    x = np.zeros(WORD_SIZE + MEASURES, np.float32)
    words = block.text.lower().split()
    x[:WORD_SIZE] = np.bincount([_word_slot(w) for w in words], minlength=WORD_SIZE)
    x[:WORD_SIZE] /= len(words)
    x[WORD_SIZE:] = (np.log1p(len(words)) / 4, block.linked, block.text[-1] in ".!?:;", place / of, min(of, 50) / 50)
    return x


# --- the network ------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors with one logistic unit for each block."""

    def __init__(self, size: int = 16, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.size = size
        inputs = PATH_SIZE + WORD_SIZE + MEASURES
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"out": draw(2 * size, 1), "bias": np.zeros(1, np.float32)}
        for way in ("f", "b"):
            self.p |= {f"{way}w": draw(inputs, 4 * size) * 0.5, f"{way}u": draw(size, 4 * size), f"{way}c": np.zeros(4 * size, np.float32)}
            self.p[f"{way}c"][size : 2 * size] = 1  # remember at first

    def _pass(self, way: str, z: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states over time, first axis, and what a backward pass needs."""
        h = self.size
        state = np.zeros((z.shape[1], h), np.float32)
        cell, out, tape = np.zeros_like(state), [], []
        u = self.p[f"{way}u"]
        for now in z:
            gates = now + state @ u
            sig = _sigmoid(gates[:, : 3 * h])
            i, f, o, g = sig[:, :h], sig[:, h : 2 * h], sig[:, 2 * h :], np.tanh(gates[:, 3 * h :])
            before, last = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out.append(state)
            tape.append((i, f, o, g, before, last, squashed))
        return np.array(out), tape

    def _back(self, way: str, grad: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gates over time and of the recurrent weights."""
        u = self.p[f"{way}u"]
        dz, du = np.zeros((*grad.shape[:2], 4 * self.size), np.float32), np.zeros_like(u)
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(len(tape) - 1, -1, -1):
            i, f, o, g, before, last, squashed = tape[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz[t] = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)])
            du += last.T @ dz[t]
            dh, dc = dz[t] @ u.T, dc * f
        return dz, du

    @staticmethod
    def _flip(sizes: np.ndarray, steps: int) -> np.ndarray:
        """For each sequence, its places backwards; padding stays at the end."""
        t = np.arange(steps)[:, None]
        return np.where(t < sizes, sizes - 1 - t, t)

    def logits(self, zf: np.ndarray, zb: np.ndarray, sizes: np.ndarray):
        flip, at = self._flip(sizes, len(zf)), np.arange(len(sizes))
        hf, tf = self._pass("f", zf)
        hb, tb = self._pass("b", zb[flip, at])
        both = np.concatenate([hf, hb[flip, at]], axis=2)
        return (both @ self.p["out"])[:, :, 0] + self.p["bias"], both, tf, tb, flip, at

    def learn(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of one batch; ``x`` is (time, page, input)."""
        logits, both, tf, tb, flip, at = self.logits(x @ self.p["fw"] + self.p["fc"], x @ self.p["bw"] + self.p["bc"], sizes)
        mask = np.arange(len(x))[:, None] < sizes
        p = _sigmoid(logits)
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / mask.sum()
        dboth = d[:, :, None] * self.p["out"][:, 0]
        h, flat = self.size, x.reshape(-1, x.shape[2])
        zf, uf = self._back("f", dboth[:, :, :h], tf)
        zb, ub = self._back("b", dboth[:, :, h:][flip, at], tb)
        zb = zb[flip, at]
        grads = {"out": both.reshape(-1, 2 * h).T @ d.reshape(-1, 1), "bias": d.sum(keepdims=True).ravel(), "fu": uf, "bu": ub}
        for way, z in (("f", zf), ("b", zb)):
            z = z.reshape(-1, 4 * h)
            grads |= {f"{way}w": flat.T @ z, f"{way}c": z.sum(0)}
        return float(loss), grads

    def label(self, pages: list[list[Block]], places: int = 20_000) -> list[np.ndarray]:
        """Which blocks are main text, page by page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            steps, take = len(pages[order[-1]]), []
            while order and (not take or (len(take) + 1) * steps <= places):
                take.append(order.pop())
            sizes = np.array([len(pages[i]) for i in take])
            paths: dict[tuple, int] = {}
            of = np.zeros((steps, len(take)), np.int64)
            rest = np.zeros((steps, len(take), WORD_SIZE + MEASURES), np.float32)
            for k, i in enumerate(take):
                for t, block in enumerate(pages[i]):
                    of[t, k] = paths.setdefault(block.path, len(paths))
                    rest[t, k] = rest_vector(block, t, len(pages[i]))
            vectors = np.array([path_vector(p) for p in paths])
            z = [(vectors @ self.p[f"{w}w"][:PATH_SIZE])[of] + rest @ self.p[f"{w}w"][PATH_SIZE:] + self.p[f"{w}c"] for w in "fb"]
            logits = self.logits(z[0], z[1], sizes)[0]
            for k, i in enumerate(take):
                out[i] = logits[: sizes[k], k] > 0
        return out


# --- invented pages ---------------------------------------------------------------


def invented_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page, and the blocks that are its main text."""
    letters = np.array(list("aeiouaeioulnrstdmchkpäéñöüçáß"))
    pick = lambda options: options[rng.integers(len(options))]
    chance = lambda p: rng.random() < p
    main: list[str] = []

    def words(low: int, high: int, stop: bool | None = None) -> str:
        n = int(np.exp(rng.uniform(np.log(low), np.log(high + 0.99))))
        made = ["".join(letters[rng.integers(0, len(letters), rng.integers(1, 10))]) for _ in range(n)]
        made = [w + pick([",", ".", ".", "."]) if chance(0.1) else w for w in made]
        line = " ".join(made).capitalize()
        return line + "." if (chance(0.6) if stop is None else stop) else line

    def named(names: list[str], tag: str | None = None) -> tuple[str, str]:
        """An element for a part: a telling tag, a telling name, or both."""
        name = pick(names) + pick(["", "", "", "-1", " box", " clearfix", " wide"])
        if tag and chance(0.5):
            return f"<{tag}>", f"</{tag}>"
        tag = tag if tag and chance(0.4) else pick(["div", "div", "section"])
        return f'<{tag} {pick(["class", "class", "id"])}="{name}">', f"</{tag}>"

    def links() -> str:
        rows = [f'<li><a href="/{i}">{words(1, 4, False)}</a></li>' for i in range(rng.integers(2, 12))]
        return "<ul>" + "".join(rows) + "</ul>" if chance(0.8) else " ".join(r[4:-5] for r in rows)

    def some(low: int = 1, high: int = 40) -> str:
        return "".join(pick(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "{}", "<span>{}</span>"]).format(words(low, high)) for _ in range(rng.integers(1, 4)))

    def part(kind: str) -> str:
        names, tag, inside = {
            "menu": (V.MENU_NAMES, "nav", links),
            "head": (V.HEAD_NAMES, "header", lambda: f"<h1>{words(1, 6, False)}</h1>" * chance(0.5) + some(1, 12)),
            "foot": (V.FOOT_NAMES, "footer", lambda: pick(["&copy; {}", "{}", "<p>{}</p>", "&copy; x.example &middot; {}"]).format(words(1, 40)) + (links() if chance(0.3) else "")),
            "side": (V.SIDE_NAMES, "aside", lambda: f"<h3>{words(1, 4, False)}</h3>" + pick([links, some])()),
            "notice": (V.NOTICE_NAMES, None, lambda: some(3, 40)),
            "advert": (V.ADVERT_NAMES, None, lambda: pick(["{}", "<p>{}</p>", "<a href='/x'>{}</a>"]).format(words(1, 40))),
            "form": (V.FORM_NAMES, "form", lambda: f"<label>{words(1, 4)}</label><input type=text><button>{words(1, 2, False)}</button>" + (some(2, 12) if chance(0.3) else "")),
            "comments": (V.COMMENT_NAMES, None, lambda: f"<h2>{words(1, 3, False)}</h2>" * chance(0.5) + "".join(f'<div class="{pick(["comment", "reply", "c", "user"])}">{some(1, 60)}</div>' for _ in range(rng.integers(1, 6)))),
            "share": (V.SHARE_NAMES, None, links),
        }[kind]
        start, end = named(names, tag)
        if kind == "form" and not start.startswith("<form"):
            start, end = start + "<form>", "</form>" + end
        return start + inside() + end

    def told(text: str) -> str:
        """A main block's text in the markup, with its references and inline tags."""
        text = text.strip()
        main.append(" ".join(entities.unescape(text).split()))
        if chance(0.3) and " " in text:
            a, b = text.split(" ", 1)
            text = pick(["<b>{}</b> {}", "<em>{}</em> {}", "<a href='/y'>{}</a> {}", "<b>{} {}"]).format(a, b)
        return text

    def article() -> str:
        out = []
        if chance(0.8):
            out.append(f"<h1>{told(words(1, 14, False))}</h1>")
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            if kind < 0.72:
                text = told(words(1, 150, None if chance(0.2) else True))
                out.append(pick(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}<br>", "<p>{}"]).format(text))
            elif kind < 0.80:
                out.append(f"<h2>{told(words(1, 8, False))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{told(words(1, 20))}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote>{told(words(3, 40))}</blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{told(words(1, 4))}</td><td>{told(words(1, 4))}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            else:
                out.append(part(pick(["advert", "share", "form", "side", "notice"])))
        return "".join(out)

    before = [k for k in ("notice", "head", "menu", "advert", "side") if chance(0.5)]
    after = [k for k in ("share", "comments", "side", "form", "advert", "menu", "foot", "notice") if chance(0.4)]
    rng.shuffle(before)
    start, end = named(V.MAIN_NAMES, pick(["article", "article", "main"]))
    if chance(0.3):
        start, end = '<div class="wrapper">' + start, end + "</div>"
    if chance(0.25):
        start, end = "<main>" + start, end + "</main>"
    body = "".join(map(part, before)) + start + article() + end + "".join(map(part, after))
    page = f"<!DOCTYPE html><html><head><title>{words(1, 9)}</title><style>p{{margin:0}}</style></head><body><script>var t='</p>';</script>{body}"
    return page + ("</body></html>" if chance(0.8) else ""), main


@lru_cache(1)
def trained(pages: int = 700, rounds: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Labeller:
    """A labeller taught on ``pages`` invented pages, by Adam."""
    rng = np.random.default_rng(seed)
    taught = []
    for _ in range(pages):
        page, main = invented_page(rng)
        blocks, y, left = blocks_of(page), [], list(main)
        for block in blocks:
            y.append(bool(left) and block.text == left[0])
            if y[-1]:
                left.pop(0)
        if left:
            continue  # broken tags ran two blocks together
        x = np.array([np.concatenate([path_vector(b.path), rest_vector(b, t, len(blocks))]) for t, b in enumerate(blocks)])
        taught.append((x, np.array(y, np.float32)))
    net = Labeller()
    first, second, step = {}, {}, 0
    for epoch in range(rounds):
        order = rng.permutation(len(taught))
        for at in range(0, len(order), batch):
            own = [taught[i] for i in order[at : at + batch]]
            sizes = np.array([len(y) for _, y in own])
            x = np.zeros((sizes.max(), len(own), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
            y = np.zeros(x.shape[:2], np.float32)
            for k, (one, label) in enumerate(own):
                x[: len(label), k], y[: len(label), k] = one, label
            _, grads = net.learn(x, y, sizes)
            step += 1
            pace = rate * (0.3 if epoch >= rounds - 2 else 1)
            for name, g in grads.items():
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                net.p[name] = (net.p[name] - pace * move).astype(np.float32)
    return net


# --- the operator -----------------------------------------------------------------


def main_text(html: str, net: Labeller) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, net.label([blocks])[0]) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", net: Labeller | None = None, together: int = 256) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; one pass, no shuffle."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    net = net or trained()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts: list[str] = []
            column = batch.column("html")
            for at in range(0, len(column), together):
                cut = [blocks_of(h or "") for h in column.slice(at, together).to_pylist()]
                texts += ["\n".join(b.text for b, keep in zip(blocks, kept) if keep) for blocks, kept in zip(cut, net.label(cut))]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    asked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return asked.mapInArrow(by_batch(make, out), "page_id long, url string, text string, n_chars long")
