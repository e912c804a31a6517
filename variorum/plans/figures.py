"""Figures as SVG: lines over chapters, and the tree of witnesses.  Both are of published size (chapters, witnesses)."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators import trees

_COLOURS = ("#7f7f7f", "#1f77b4", "#d62728", "#2ca02c", "#9467bd")


def _svg(width: float, height: float, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:.0f} {height:.0f}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<rect width="{width:.0f}" height="{height:.0f}" fill="#fff"/>', *body, "</svg>\n"])


def line_chart(df: DataFrame, x: str, series: dict[str, str], path: str | Path, title: str = "", width: int = 900, height: int = 420) -> Path:
    """Columns ``series`` (column -> label) over ``x``; points that are null are left out."""
    rows = df.select(x, *series).orderBy(x).collect()
    xs = [r[x] for r in rows]
    ys = [float(r[c]) for r in rows for c in series if r[c] is not None]
    low, high = min([0.0, *ys]), max([*ys, 1e-9])
    first, span = (min(xs), max(max(xs) - min(xs), 1)) if xs else (0, 1)
    px = lambda v: 50 + (v - first) / span * (width - 80)
    py = lambda v: height - 40 - (v - low) / (high - low) * (height - 90)
    body = [f'<text x="50" y="20" font-size="14">{escape(title)}</text>']
    for k in range(5):
        v = low + (high - low) * k / 4
        body.append(f'<path d="M50 {py(v):.1f}H{width - 30}" stroke="#ddd"/><text x="4" y="{py(v) + 4:.1f}">{v:.3f}</text>')
    body += [f'<text x="{px(v):.1f}" y="{height - 22}" text-anchor="middle">{v}</text>' for v in xs]
    for (column, label), colour, k in zip(series.items(), _COLOURS, range(len(series))):
        points = [(px(r[x]), py(float(r[column]))) for r in rows if r[column] is not None]
        body.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in points)}"/>')
        body += [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="3" fill="{colour}"/>' for a, b in points]
        body.append(f'<text x="{60 + 190 * k}" y="38" fill="{colour}">{escape(label)}</text>')
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(_svg(width, height, body), encoding="utf-8")
    return out


def dendrogram(tree: trees.Linkage, path: str | Path, families: dict[str, str] | None = None, row: int = 12, width: int = 700) -> Path:
    """A linkage as a tree from left (height 0 at the right), leaves in the order of their merges."""
    n, names = len(tree.names), list(tree.names)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    for k, (a, b) in enumerate(zip(tree.left, tree.right)):
        members[n + k] = members[int(a)] + members[int(b)]
    order = members[n + len(tree.left) - 1] if len(tree.left) else list(range(n))
    top = max([float(h) for h in tree.height], default=1.0) or 1.0
    colour = {f: _COLOURS[i % len(_COLOURS)] for i, f in enumerate(sorted(set((families or {}).values())))}
    at: dict[int, tuple[float, float]] = {}
    body = []
    for place, i in enumerate(order):
        y = 20 + place * row
        at[i] = width - 120.0, y
        fill = colour.get((families or {}).get(names[i], ""), "#000")
        body.append(f'<text x="{width - 114}" y="{y + 4}" fill="{fill}">{escape(names[i])}</text>')
    for k, (a, b, h) in enumerate(zip(tree.left, tree.right, tree.height)):
        (xa, ya), (xb, yb) = at[int(a)], at[int(b)]
        x = (width - 120) * (1 - float(h) / top) + 10 * float(h) / top
        body.append(f'<path d="M{xa:.1f} {ya:.1f}H{x:.1f}V{yb:.1f}H{xb:.1f}" fill="none" stroke="#555"/>')
        at[n + k] = x, (ya + yb) / 2
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(_svg(width, 40 + n * row, body), encoding="utf-8")
    return out
