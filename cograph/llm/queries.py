"""Queries of this subpackage, by name, and their SQL."""

from cograph.llm import contamination, language, licences, mixing, neighbours, secrets, simhash, substrings, tokens, urls


def queries() -> dict:
    return {
        "op1_language": language.op1_language,
        "op2_substrings": substrings.op2_substrings,
        "op3_licences": licences.op3_licences,
        "op4_secrets": secrets.op4_secrets,
        "op5_tokens": tokens.op5_tokens,
        "op6_simhash": simhash.op6_simhash,
        "op7_urls": urls.op7_urls,
        "op8_contamination": contamination.op8_contamination,
        "op9_mixing": mixing.op9_mixing,
        "op10_neighbours": neighbours.op10_neighbours,
    }


def oracle_sql() -> dict:
    return {"op4_secrets": secrets.secrets_sql(), "op9_mixing": mixing.mixing_sql(), "op10_neighbours": neighbours.neighbours_sql()}
