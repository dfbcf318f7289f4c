"""The queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import chat, hilbert, packing, sentencepiece_codec, simhash, sketch, substring, topk, toxicity, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_sentencepiece": sentencepiece_codec.query,
        "op2_sketch": sketch.query,
        "op3_simhash": simhash.query,
        "op4_hilbert": hilbert.query,
        "op5_warc": warc.query,
        "op6_toxicity": toxicity.query,
        "op7_packing": packing.query,
        "op8_topk": topk.query,
        "op9_chat": chat.query,
        "op10_substring": substring.query,
    }


def oracle_sql() -> dict[str, str]:
    return {}
