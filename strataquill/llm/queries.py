"""The corpus operators' queries and oracles, by name."""

from strataquill.llm.op01_toxicity import op1_toxicity
from strataquill.llm.op02_tokens import op2_tokens
from strataquill.llm.op03_license import op3_license
from strataquill.llm.op04_secrets import op4_secrets
from strataquill.llm.op05_mix import op5_mix
from strataquill.llm.op06_decontaminate import op6_decontaminate
from strataquill.llm.op07_lines import op7_lines
from strataquill.llm.op08_urls import op8_urls
from strataquill.llm.op09_simhash import op9_simhash
from strataquill.llm.op10_quality import op10_quality
from strataquill.llm.oracles import ORACLES  # noqa: F401


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_tokens, op3_license, op4_secrets, op5_mix, op6_decontaminate, op7_lines, op8_urls, op9_simhash, op10_quality, pipeline)}
