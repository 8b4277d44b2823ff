"""The thin queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from citewell.llm import chat, langid, media, mixing, neardup, pieces, pii, quality, runs, secrets, trie, urlfilter, weighted

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_pii": pii.op2_pii,
    "op3_pieces": pieces.op3_pieces,
    "op4_mixing": mixing.op4_mixing,
    "op5_secrets": secrets.op5_secrets,
    "op6_neardup": neardup.op6_neardup,
    "op7_quality": quality.op7_quality,
    "op8_media": media.op8_media,
    "op9_langid": langid.op9_langid,
    "op10_urlfilter": urlfilter.op10_urlfilter,
    "op11_weighted": weighted.op11_weighted,
    "op12_trie": trie.op12_trie,
    "op13_runs": runs.op13_runs,
}
ORACLES = {
    "op1_chat": chat.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op7_quality": quality.ORACLE,
    "op10_urlfilter": urlfilter.ORACLE,
    "op12_trie": trie.ORACLE,
}
