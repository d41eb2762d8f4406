"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from keyloom.llm import codes, decontam, fim, htmltext, langid, linedup, media, neardup, packing, sharding, suffixes, tokencount, urlfilter


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_near_dedup": neardup.op1_near_dedup,
    "op2_packing": packing.op2_packing,
    "op3_url_filters": urlfilter.op3_url_filters,
    "op4_token_counts": tokencount.op4_token_counts,
    "op5_html_extraction": htmltext.op5_html_extraction,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_media": media.op7_media,
    "op8_sharding": sharding.op8_sharding,
    "op9_language_id": langid.op9_language_id,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_line_dedup": linedup.op11_line_dedup,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_vector_codes": codes.op13_vector_codes,
    "pack_conversations": packing.pack_conversations,
    "pipeline": pipeline,
}

ORACLE = {
    "op10_decontamination": decontam.SQL,
    "op11_line_dedup": linedup.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_vector_codes": codes.SQL,
}
