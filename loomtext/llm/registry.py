"""The training-data operators' queries and the SQL that some have."""

from __future__ import annotations

from . import ann, bitsliced, chat_format, html_template, langid, lm, mixing, packing, simhash, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_ann": ann.op2_ann,
    "op3_html_template": html_template.op3_html_template,
    "op4_simhash": simhash.op4_simhash,
    "op5_bitsliced": bitsliced.op5_bitsliced,
    "op6_packing": packing.op6_packing,
    "op7_lm_score": lm.op7_lm_score,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_langid": langid.op9_langid,
    "op10_mixing": mixing.op10_mixing,
}
SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op5_bitsliced": bitsliced.OP5_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
