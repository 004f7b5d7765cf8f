"""Image kernels in numpy, for use inside models: cropping, warping, masks, gradients."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

NORMS = ("L1", "L1-sqrt", "L2", "L2-Hys")


def to_channels(image: np.ndarray) -> np.ndarray:
    """Height, width, 3: grey is repeated, alpha dropped."""
    if image.ndim == 2:
        image = np.repeat(image[:, :, None], 3, axis=2)
    return image[:, :, :3]


def reverse_colors(image: np.ndarray) -> np.ndarray:
    return image[..., ::-1]


def mask_image(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Zero where the mask is zero."""
    return image * (mask[..., None] > 0)


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float = 0.0, reflect: bool = False) -> np.ndarray:
    """Bilinear values at (x, y); outside is ``fill``, or mirrored at the edges."""
    h, w = image.shape[:2]
    if reflect:
        fold = lambda v, n: np.abs((v + n - 1) % (2 * max(n - 1, 1)) - (n - 1)) if n > 1 else np.zeros_like(v)
        x, y = fold(x, w), fold(y, h)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((*x.shape, image.shape[2]))
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            weight = (1 - np.abs(x - xi)) * (1 - np.abs(y - yi))
            inside = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            value = np.where(inside[..., None], image[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)], fill)
            out += weight[..., None] * value
    return out


def warp_affine(image: np.ndarray, matrix: np.ndarray, size: tuple[int, int], fill: float = 0.0) -> np.ndarray:
    """Image (h, w, c) under a forward 2 x 3 matrix, in a frame of (height, width)."""
    full = np.vstack([matrix, [0, 0, 1]])
    back = np.linalg.inv(full)
    v, u = np.mgrid[: size[0], : size[1]].astype(float)
    return sample(image, back[0, 0] * u + back[0, 1] * v + back[0, 2], back[1, 0] * u + back[1, 1] * v + back[1, 2], fill)


def crop_box(image: np.ndarray, box: Sequence[float], size: int, enlarge: float = 1.2) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """The enlarged box (xyxy) scaled to a square frame, each axis on its own; outside is zero. Also the box used."""
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    w, h = (box[2] - box[0]) * enlarge, (box[3] - box[1]) * enlarge
    left, top = cx - w / 2, cy - h / 2
    at = (np.arange(size) + 0.5) / size
    x, y = np.meshgrid(left + at * w - 0.5, top + at * h - 0.5)
    return sample(image, x, y), (left, top, left + w, top + h)


def crop_square(image: np.ndarray, box: Sequence[float], size: int, enlarge: float = 1.2) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """A square of the enlarged longer side around the box's centre, edges mirrored."""
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    side = max(box[2] - box[0], box[3] - box[1]) * enlarge
    left, top = cx - side / 2, cy - side / 2
    at = (np.arange(size) + 0.5) / size * side - 0.5
    x, y = np.meshgrid(left + at, top + at)
    return sample(image, x, y, reflect=True), (left, top, left + side, top + side)


def rescale(image: np.ndarray, size: int, padding: bool = True) -> tuple[np.ndarray, float, tuple[int, int, int, int]]:
    """(image, scale, padding left top right bottom): fitted into a square; an odd pixel goes right and bottom."""
    h, w = image.shape[:2]
    scale = min(size / h, size / w)
    nh, nw = int(h * scale), int(w * scale)
    y, x = np.meshgrid((np.arange(nh) + 0.5) / scale - 0.5, (np.arange(nw) + 0.5) / scale - 0.5, indexing="ij")
    small = sample(image, np.clip(x, 0, w - 1), np.clip(y, 0, h - 1))
    if not padding:
        return small, scale, (0, 0, 0, 0)
    left, top = (size - nw) // 2, (size - nh) // 2
    pads = (left, top, size - nw - left, size - nh - top)
    return np.pad(small, ((top, pads[3]), (left, pads[2]), (0, 0))), scale, pads


def align_eyes(image: np.ndarray, points: np.ndarray, size: int = 112, enlarge: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Face turned so that the eyes are level and scaled to the frame, with its 68 points moved likewise."""
    left, right = points[36:42].mean(0), points[42:48].mean(0)
    angle = np.arctan2(right[1] - left[1], right[0] - left[0])
    c, s = np.cos(-angle), np.sin(-angle)
    turn = np.array([[c, -s], [s, c]])
    anchors = np.stack([left, right, points[30], points[48], points[54]]) @ turn.T
    span = np.ptp(anchors, axis=0).max() * enlarge
    middle = (anchors.min(0) + anchors.max(0)) / 2
    scale = size / max(span, 1e-6)
    matrix = np.column_stack([scale * turn, size / 2 - scale * middle])
    return warp_affine(image, matrix, (size, size)), points @ matrix[:, :2].T + matrix[:, 2]


def hull_mask(points: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """1 inside the convex hull of points, by half planes of its edges."""
    order = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(p: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in p:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(q - out[-1], 0))[2] <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(chain(order) + chain(order[::-1]))
    y, x = np.mgrid[: size[0], : size[1]]
    inside = np.ones(size, bool)
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    return inside.astype(np.uint8)


def hog(image: np.ndarray, orientations: int = 10, cell: int = 8, block: int = 2, norm: str = "L2", root: bool = True) -> np.ndarray:
    """Histograms of oriented gradients: per cell by orientation, normalised over blocks of cells, as a vector."""
    if norm not in NORMS:
        raise ValueError(f"norm is one of {', '.join(NORMS)}")
    x = np.sqrt(np.maximum(image, 0)) if root else image.astype(float)
    x = x[..., None] if x.ndim == 2 else x
    gx, gy = np.zeros_like(x), np.zeros_like(x)
    gx[:, 1:-1] = x[:, 2:] - x[:, :-2]
    gy[1:-1] = x[2:] - x[:-2]
    size = np.hypot(gx, gy)
    best = size.argmax(2)[..., None]
    size, gx, gy = (np.take_along_axis(a, best, 2)[..., 0] for a in (size, gx, gy))
    way = np.rad2deg(np.arctan2(gy, gx)) % 180
    rows, cols = x.shape[0] // cell, x.shape[1] // cell
    index = np.minimum((way * orientations / 180).astype(int), orientations - 1)[: rows * cell, : cols * cell]
    weight = size[: rows * cell, : cols * cell]
    where = (np.arange(rows * cell) // cell)[:, None] * cols + (np.arange(cols * cell) // cell)[None]
    counts = np.bincount((where * orientations + index).ravel(), weight.ravel(), rows * cols * orientations).reshape(rows, cols, orientations) / cell**2
    blocks = np.stack([counts[i : rows - block + 1 + i, j : cols - block + 1 + j] for i in range(block) for j in range(block)], 2).reshape(rows - block + 1, cols - block + 1, -1)
    eps = 1e-5
    if norm.startswith("L1"):
        out = blocks / (np.abs(blocks).sum(2, keepdims=True) + eps)
        out = np.sqrt(out) if norm == "L1-sqrt" else out
    else:
        out = blocks / np.sqrt((blocks**2).sum(2, keepdims=True) + eps**2)
        if norm == "L2-Hys":
            out = np.minimum(out, 0.2)
            out = out / np.sqrt((out**2).sum(2, keepdims=True) + eps**2)
    return out.ravel()


def face_features(image: np.ndarray, points: np.ndarray, size: int = 112) -> np.ndarray:
    """Aligned, masked to the hull of its points, as gradients. ValueError unless there are 68 points."""
    if points.shape != (68, 2):
        raise ValueError("68 points are needed")
    face, moved = align_eyes(image, points, size)
    return hog(mask_image(face, hull_mask(moved, (size, size))))
