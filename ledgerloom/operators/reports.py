"""Small results as text: digests, timelines, patterns, routes, coverage.  For rows that have come to the driver by a feature's own limit."""

from __future__ import annotations

from collections.abc import Iterable

TITLES = {"fact": "New confident facts", "gap": "Resolved gaps", "wiki": "Wiki pages rebuilt"}


def digest(items: Iterable[dict], since: str, until: str) -> str:
    """Markdown of a digest's items (section, headline), 25 a section at most; a section without items is left out."""
    lines, items = [f"# Digest, {since} to {until}", ""], list(items)
    if not items:
        return "\n".join([*lines, "(no items)"]) + "\n"
    for section, title in TITLES.items():
        own = [x["headline"] for x in items if x["section"] == section]
        if own:
            lines += [f"## {title} ({len(own)})", "", *(f"- {x}" for x in own), ""]
    return "\n".join(lines)


def listing(title: str, rows: Iterable[dict], form: str, hint: str) -> str:
    """A title and a line for every row, or a hint where there is none."""
    lines = [f"  - {form.format(**r)}" for r in rows]
    return "\n".join([title, *(lines or [f"hint: {hint}"])]) + "\n"


def counts(rows: Iterable[dict]) -> str:
    return ", ".join(f"{'(none)' if r['key'] is None else r['key']}={r['n']}" for r in rows)


def truncated(text: str, most: int = 120) -> str:
    """White space as one blank, cut with an ellipsis."""
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 1] + "…"
