"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from webskein.llm import ann, bpe, decontaminate, langid, neardup, ppm, quality, secrets, urls, warc

QUERIES = {"op2_urls": urls.op2_urls, "op1_ann": ann.op1_ann, "op6_ppm": ppm.op6_ppm, "op8_bpe": bpe.op8_bpe, "op7_decontaminate": decontaminate.op7_decontaminate, "op9_quality": quality.op9_quality, "op5_langid": langid.op5_langid, "op4_neardup": neardup.op4_neardup, "op3_secrets": secrets.op3_secrets, "op10_warc": warc.op10_warc}
ORACLES = {"op2_urls": urls.OP2_SQL, "op1_ann": ann.OP1_SQL, "op4_neardup": neardup.OP4_SQL, "op3_secrets": secrets.OP3_SQL, "op10_warc": warc.OP10_SQL}
