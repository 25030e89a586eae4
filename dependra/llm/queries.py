"""The queries of this subpackage, and SQL for those that SQL can express."""

from dependra.llm import chat, decontaminate, language, lines, mixing, neardup, neighbours, quality, substrings, urls

QUERIES = {
    "op1_language": language.op1_language,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_neardup": neardup.op3_neardup,
    "op4_chat": chat.op4_chat,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_lines": lines.op6_lines,
    "op7_urls": urls.op7_urls,
    "op8_mixing": mixing.op8_mixing,
    "op9_substrings": substrings.op9_substrings,
    "op10_quality": quality.op10_quality,
}

ORACLES = {
    "op3_neardup": neardup.OP3_SQL,
    "op4_chat": chat.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_lines": lines.OP6_SQL,
    "op7_urls": urls.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_substrings": substrings.OP9_SQL,
}
