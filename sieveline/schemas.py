"""Record types. Optional keys are nullable fields; types are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, B, L, D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()

CRITIQUE = struct(is_good=B, predicted_label=S, logp_a=D, logp_b=D, margin=D, confident=B, confidence_threshold=D, _inferred=B, _note=S)
SENTINEL = struct(name=S, prompt=S, response=S, expected=S, passed=B, description=S)
METADATA = struct(timestamp=S, git_commit=S, git_branch=S, seed=L, shard_id=S, repaired=B, repair_timestamp=S, repair_operations=T.ArrayType(S), sentinel_results=T.ArrayType(SENTINEL))
SFT_EXAMPLE = struct(instruction=S, response=S, prompt=S, completion=S, instruction_critique=CRITIQUE, pair_critique=CRITIQUE, metadata=METADATA)
SFT_VALIDATED = struct(instruction=S, response=S, formatted_text=S, instruction_type=S)
INSTRUCTION = struct(id=S, instruction=S, instruction_type=S, template=S, pool=S)
TEST_INSTRUCTION = struct(id=S, instruction=S, expected_type=S, type=S, template=S, generated_at=S)
PREFERENCE_PAIR = struct(id=S, prompt=S, instruction=S, chosen=S, rejected=S, instruction_type=S, negative_type=S, confidence_margin=D, margin=D, confident=B, source=S, timestamp=S)
NEGATIVE = struct(instruction=S, instruction_type=S, good_response=S, negative_response=S, negative_type=S, example_id=S, timestamp=S)
EVAL_RESULT = struct(instruction=S, response=S, success=B, failure_reason=S, tokens_generated=L, instruction_type=S)
MANIFEST_ENTRY = struct(session=S, path=S, type=S, timestamp=S, success=B, error=S, git_commit=S, git_branch=S, git_dirty=B, parameters=T.MapType(S, S))
PRINCIPLE = struct(id=S, text=S, category=S)
TURN = struct(conv_id=L, turn=L, role=S, text=S)
