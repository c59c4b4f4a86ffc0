"""Images as arrays of rows, columns and red, green, blue: codecs, fitting, crops and drawing.

Files are read and written by a codec: two functions, bytes to array and back.  ``codec()`` takes an image library
where one is installed, else plain PPM.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Box = tuple[int, int, int, int]  # top, right, bottom, left
GREEN, RED, BLACK = (0, 255, 0), (255, 0, 0), (0, 0, 0)


@dataclass(frozen=True)
class Codec:
    decode: Callable[[bytes], np.ndarray]
    encode: Callable[[np.ndarray], bytes]
    suffix: str


def _read_ppm(content: bytes) -> np.ndarray:
    head = io.BytesIO(content)
    if head.readline().strip() != b"P6":
        raise ValueError("not a PPM image")
    w, h = map(int, head.readline().split())
    head.readline()
    body = head.read(3 * w * h)
    if w <= 0 or h <= 0 or len(body) < 3 * w * h:
        raise ValueError("a PPM image that ends early")
    return np.frombuffer(body, np.uint8).reshape(h, w, 3)


def _write_ppm(image: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


PPM = Codec(_read_ppm, _write_ppm, ".ppm")


def codec() -> Codec:
    """JPEG, PNG and whatever else the installed library reads; PPM without one."""
    try:
        from PIL import Image
    except ImportError:
        return PPM

    def write(image: np.ndarray) -> bytes:
        out = io.BytesIO()
        Image.fromarray(image).save(out, "JPEG", quality=95)
        return out.getvalue()

    return Codec(lambda b: np.asarray(Image.open(io.BytesIO(b)).convert("RGB")), write, ".jpg")


def swap_channels(image: np.ndarray) -> np.ndarray:
    """Blue, green, red to red, green, blue, and back."""
    return image[:, :, ::-1]


def fit(image: np.ndarray, side: int = 2048) -> np.ndarray:
    """No side longer than ``side``, proportions kept; pixels are means over the areas that they cover."""
    h, w = image.shape[:2]
    scale = min(1.0, side / max(h, w))
    if scale == 1.0:
        return image
    rows, cols = max(1, round(h * scale)), max(1, round(w * scale))

    def edges(n: int, k: int) -> np.ndarray:
        return np.minimum((np.arange(k) * n) // k, n - 1)

    sums = np.add.reduceat(np.add.reduceat(image.astype(np.float64), edges(h, rows), axis=0), edges(w, cols), axis=1)
    area = np.diff(np.append(edges(h, rows), h))[:, None] * np.diff(np.append(edges(w, cols), w))[None]
    return np.rint(sums / area[:, :, None]).astype(np.uint8)


def rescaled(box: Box, original: tuple[int, ...], processed: tuple[int, ...]) -> Box:
    """A box on the processed image on the original one, truncated."""
    if original[:2] == processed[:2]:
        return box
    h, w = original[0] / processed[0], original[1] / processed[1]
    return int(box[0] * h), int(box[1] * w), int(box[2] * h), int(box[3] * w)


def area(box: Box) -> int:
    return (box[1] - box[3]) * (box[2] - box[0])


def crop(image: np.ndarray, box: Box, pad: int = 0) -> np.ndarray:
    """The part of an image within a box grown by ``pad`` and clipped."""
    t, r, b, l = box  # noqa: E741
    return image[max(0, t - pad) : min(image.shape[0], b + pad), max(0, l - pad) : min(image.shape[1], r + pad)]


# letters of tags, five rows of three bits each
_GLYPHS = {
    "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 3, 1, 7), "4": (5, 5, 7, 1, 1), "5": (7, 4, 7, 1, 7),
    "6": (7, 4, 7, 5, 7), "7": (7, 1, 2, 2, 2), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7), "F": (7, 4, 6, 4, 4), "A": (2, 5, 7, 5, 5),
    "a": (0, 6, 3, 5, 7), "c": (0, 3, 4, 4, 3), "e": (2, 5, 7, 4, 3), "r": (0, 5, 6, 4, 4), ":": (0, 2, 0, 2, 0), " ": (0, 0, 0, 0, 0),
}


def text_mask(text: str, size: int = 1) -> np.ndarray:
    """Lines of text as a mask; characters of no glyph are blank."""
    lines = text.split("\n")
    out = np.zeros((6 * len(lines), 4 * max(map(len, lines))), bool)
    for y, line in enumerate(lines):
        for x, ch in enumerate(line):
            for k, bits in enumerate(_GLYPHS.get(ch, _GLYPHS[" "])):
                out[6 * y + k, 4 * x : 4 * x + 3] = [bits >> s & 1 for s in (2, 1, 0)]
    return np.kron(out, np.ones((size, size), bool))


def draw(image: np.ndarray, boxes: list[Box], colours: list[tuple[int, int, int]] | None = None, labels: list[str] | None = None, width: int = 3, size: int = 2) -> np.ndarray:
    """A copy with rectangles, and with tags above them, or a little below where they would leave the image."""
    out = image.copy()
    h, w = out.shape[:2]
    for k, (top, right, bottom, left) in enumerate(boxes):
        colour = colours[k] if colours else GREEN
        for o in range(width):
            t, b = np.clip((top - o, bottom + o), 0, h - 1)
            l, r = np.clip((left - o, right + o), 0, w - 1)  # noqa: E741
            out[t, l : r + 1] = out[b, l : r + 1] = colour
            out[t : b + 1, l] = out[t : b + 1, r] = colour
        if labels:
            mask = text_mask(labels[k], size)
            y = top - mask.shape[0] - 10
            y = bottom + 10 if y < 0 else y
            back = out[y : y + mask.shape[0] + 4, max(0, left) : max(0, left) + mask.shape[1] + 8]
            back[:] = colour
            inner = back[2 : 2 + mask.shape[0], 4 : 4 + mask.shape[1]]
            inner[mask[: inner.shape[0], : inner.shape[1]]] = BLACK
    return out


def tags(areas: list[int], least: int | None = None) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Labels and colours of faces: plain numbers, or, given a least area, areas in green or red."""
    if least is None:
        return [f"Face {k + 1}" for k in range(len(areas))], [GREEN] * len(areas)
    return [f"Face {k + 1}\nArea: {int(a)}" for k, a in enumerate(areas)], [GREEN if a >= least else RED for a in areas]
