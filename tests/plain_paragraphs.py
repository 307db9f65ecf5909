"""A plain fold of lines into paragraphs, which reads the whole text that it builds; tests hold the expression against it."""

import re
from statistics import median as middle

HAN = re.compile(r"[\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]")
#: What marks list items, ends of sentences and continuations.
LIST_ITEM = re.compile(r"\s*(?:[-•●▪]|(?:[0-9]+|[A-Za-z])[.)、])\s+")
HARD_END = re.compile(r"[。！？!?；;][”’\"')）】]*\Z")
GOES_ON = re.compile(r"[的得地了着过和与及或但而也就都不没更最则却并a-z]")
OPEN_END = re.compile(r"[，,、：:（(\[【]\Z")
REPAIRS = [(re.compile(p), t) for p, t in ((r"[\t\f\v ]+", " "), (r"[\s\ufeff]+([,.;:!?%）)\]}])", r"\1"), (r"([（(\[{])[\s\ufeff]+", r"\1"), (r"([A-Za-z0-9][,;:!?])(?=[A-Za-z])", r"\1 "), (r"([A-Za-z0-9]\.)(?=[A-Z])", r"\1 "), (f"({HAN.pattern})([A-Za-z])", r"\1 \2"), (f"([A-Za-z])({HAN.pattern})", r"\1 \2"))]


BLANK = " \t\n\r\f\v\ufeff\u00a0\u3000"


def respaced(text: str) -> str:
    for pattern, to in REPAIRS:
        text = pattern.sub(to, text)
    return text


def repaired(text: str) -> str:
    return respaced(text).strip(BLANK)


def joined(left: str, right: str) -> str:
    """repaired(left + right) of two parts that are repaired: no rule looks further than NEAR characters from the joint."""
    head, tail = left[:-NEAR], right[NEAR:]
    return (head + respaced(left[-NEAR:] + right[:NEAR]) + tail).strip(BLANK)


LATIN, BEFORE_LATIN = re.compile("[A-Za-z]"), re.compile(r"[A-Za-z0-9.!?,;:]")
NEAR = 6


def glued(left: str, right: str) -> str:
    """Two repaired lines of one paragraph as one."""
    if left.endswith("-") and "a" <= right[:1] <= "z":
        return joined(left[:-1], right)
    a, b = left[-1:], right[:1]
    space = bool(a and b) and ((LATIN.match(b) and (BEFORE_LATIN.match(a) or HAN.match(a))) or (LATIN.match(a) and (b.isdecimal() or HAN.match(b))))
    return joined(left + " " * bool(space), right)


class Paragraphs:
    """Folds lines in order into paragraphs by gaps, indents, list marks and how texts end and start."""

    def __init__(self, heights: list[float], lefts: list[float]) -> None:
        self.height, self.left = middle(heights), middle(lefts)
        self.done: list[str] = []
        self.text, self.before = "", None

    def add(self, text: str, box: tuple[float, float, float, float]) -> None:
        """box: left, top, bottom, height. A blank line is skipped, but later gaps count from it."""
        text, before, self.before = repaired(text), self.before, box
        if before is None:
            self.text = text
        elif text:
            gap = box[1] - before[2]
            split = (gap > 0.72 * self.height and not self._bridges(text, before, box, gap)) or LIST_ITEM.match(text) or (box[0] - self.left > 1.15 * self.height and self.text.endswith(tuple("。！？.!?")))
            if split:
                self._close()
                self.text = text
            else:
                self.text = glued(self.text, text)

    def _bridges(self, text: str, before: tuple, box: tuple, gap: float) -> bool:
        tall, low = max(before[3], box[3]), min(before[3], box[3])
        if not self.text or HARD_END.search(self.text) or LIST_ITEM.match(text) or gap > 2.5 * self.height:
            return False
        if tall / max(1, low) > 1.35 or abs(box[0] - before[0]) > 2 * self.height:
            return False
        if OPEN_END.search(self.text) or GOES_ON.match(text):
            return True
        tail = re.sub(r"\s+", "", re.split("[。！？!?；;]", self.text)[-1])
        return 1 <= len(tail) <= 3 and all(HAN.match(c) for c in tail) and bool(HAN.match(text))

    def _close(self) -> None:
        if self.text:
            self.done.append(self.text)

    def result(self) -> str:
        self._close()
        return "\n\n".join(self.done)


def folded(lines: list[dict]) -> str:
    boxes = []
    for x in lines:
        poly = x["poly"] if x["poly"] is not None else []
        if len(poly) < 4:
            return "\n".join(t for t in (repaired(y["text"]) for y in lines) if t)
        xs, ys = [p["x"] for p in poly], [p["y"] for p in poly]
        boxes.append((min(xs), min(ys), max(ys), max(1, max(ys) - min(ys))))
    if not boxes:
        return ""
    fold = Paragraphs([b[3] for b in boxes], [b[0] for b in boxes])
    for x, box in zip(lines, boxes, strict=True):
        fold.add(x["text"], box)
    return fold.result()
