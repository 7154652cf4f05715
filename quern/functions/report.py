"""The Markdown report of a saved search."""

from __future__ import annotations

from collections.abc import Sequence


def render(meta: dict, title: str, notes: str, hits: Sequence[str]) -> str:
    """A title, the facts of the search, an optional summary, and the hits as markdown_hit gives them."""
    facts = {"Query": meta["query"], "Codebase root(s)": meta["roots"], "Results": len(hits), "Model": meta["model"], "Generated": meta["time"]}
    head = [f"# {title or meta['query']}", "", *(f"- **{k}:** {v}" for k, v in facts.items())]
    summary = ["", "## Summary", "", notes.rstrip("\n")] if notes.strip() else []
    body = "".join(hits) or "\nNo matches found.\n"
    return "\n".join([*head, *summary, "", "## Results", ""]) + body
