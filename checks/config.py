"""Settings shared by the registered queries and their SQL."""

from __future__ import annotations

# A sentence with contractions, possessives and numbers, put before each text,
# since the given texts hold none.
PHRASE_PREFIX = ("It's the king's landing, isn't it? They couldn't've known 105 men. he d ve gone -- "
                 "Don’t say you'll 1,234 or 2000017 cannot s go  m'lady; gonna (now) ")
ALIASES = {
    "THE": ["THEA", "THRE"], "OF": ["OUEN"], "": ["IS", "TO"], "ERING": [], "ANING": ["ONIN"],
    "THNT": ["THSH"], "REES": [], "TION": ["ESRE", "ERRE"], "VON": [], "ERAN": [],
}
SHOWS = ("show 0", "show 1", "show 2")
ALIAS_ROWS = [(show, canonical, order, alias) for show in SHOWS
              for order, (canonical, names) in enumerate(ALIASES.items()) for alias in names or [None]]
LINK_EXCLUDED = ("/The", "/and", "/En")
MIN_RATIO = 80
EDIT_RATIO = 60
PARTIAL_RATIO = 60
RANK_ROUNDS = 30
TOP_NAMES = 20
# Of two shows their own characters, removed names, decay and length of lists; the third takes the common values.
SETTINGS = (("show 0", 6, ["", "OF"], False, 4), ("show 2", None, [], None, 12))
# Line numbers of a segment: a conversation's lie within 1,000, so this cuts each in pieces of three turns.
SEGMENT_LENGTH = 3
