"""Settings of the scoring and correction operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    primary: str = "es"
    secondary: str = "en"
    add_k: float = 0.5
    vocabulary: float = 100_000.0
    bigram_weight: float = 0.6
    floor_frequency: int = 2
    sigma_floor: float = 0.25
    temperature: float = 1.0
    language_weight: float = 1.0
    scan_limit: int = 20_000
    completion_limit: int = 8
    unigram_limit: int = 50
    continuation_limit: int = 24
    personal_limit: int = 8
    completion_char_cost: float = 0.5
    evidence_floor: float = -1.25
    evidence_dead_zone: float = 1.0
    evidence_cap: float = 1.1
    boosted_z: float = -0.5
    twin_dominance: float = 10.0
    split_min_length: int = 5
    split_cost: float = 5.0
    split_positions: int = 12
    retention: int = 20
    frecency_half_life_days: float = 30.0
    frecency_entries: int = 60


DEFAULT = Config()

# The keyboard and the letters that words may be sampled by.
KEY_ROWS = ("qwertyuiopð", "asdfghjklæö", "zxcvbnmþ")
ROW_OFFSETS = (0.0, 0.5, 0.75)
ACUTE = {"á": "a", "é": "e", "í": "i", "ó": "o", "ú": "u", "ý": "y"}
CONFUSIONS = ("dð", "ðd", "oö", "öo", "ðþ", "þð", "tþ", "þt", "vð")
LANE_CONFUSIONS = ("dð", "tþ", "oö", "ðþ", "þð", "vð")
RESTORATIONS = {"a": "á", "e": "é", "i": "í", "o": "óö", "u": "ú", "y": "ý", "d": "ð", "t": "þ", "v": "ð"}
FIRST_LETTERS = "aábcdðeéfghiíjklmnoópqrstuúvwxyýzþæö"
SECOND_LETTERS = "aáeéiíoóuúyýhnrstlðgkm"
EDIT_ALPHABET = "aábcdðeéfghiíjklmnoópqrstuúvwxyýzþæö'’"


def key_centers() -> dict[str, tuple[float, float]]:
    """Centre of each key; accented letters share the key of their base letter."""
    at = {c: (ROW_OFFSETS[r] + i, float(r)) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
    return at | {a: at[b] for a, b in ACUTE.items()}


def substitution_cost(typed: str, intended: str, sigma: float = 0.7, least: float = 0.35, most: float = 8.0, unknown: float = 5.0, confusion: float = 1.5) -> float:
    """Cost of typing one letter where another was meant."""
    if typed == intended:
        return 0.0
    if typed + intended in CONFUSIONS:
        return confusion
    keys = key_centers()
    if typed not in keys or intended not in keys:
        return unknown
    (a, b), (c, d) = keys[typed], keys[intended]
    return min(max(((a - c) ** 2 + (b - d) ** 2) / (2 * sigma * sigma), least), most)
