"""Bounds of a search run, in one place.

Nothing is cut by default: each bound is ``None`` or an open value until the caller sets it.
``CATALOGUE_LIMITS`` holds the values that the notice catalogue applies to its own requests.
"""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchLimits:
    query_chars: int | None = None      # text of a search
    region_chars: int | None = None
    max_page: int | None = None
    max_page_size: int | None = None
    max_tokens: int | None = None       # words of a search that become concepts
    phrase_chars: int | None = None     # longest quoted phrase
    domains: int | None = None          # domains that a seed word opens
    expansion_terms: int | None = None  # words of an expansion
    weak_words: int | None = None       # general words that a weak search asks for
    default_page_size: int = 20


# --- fixed values: bounds that the catalogue applies to a request ---
CATALOGUE_LIMITS = SearchLimits(query_chars=120, region_chars=50, max_page=500, max_page_size=50, max_tokens=8,
                                phrase_chars=60, domains=2, expansion_terms=12, weak_words=4)
