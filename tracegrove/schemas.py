"""Row layouts of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_INTS = T.ArrayType(T.IntegerType())
_MASK = T.ArrayType(T.ByteType())
_DOUBLES = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EXAMPLE = _struct(input_value=T.StringType(), output_value=T.StringType())

PROMPT = _struct(id=T.StringType(), prompt=T.StringType(), answer=T.StringType())

PROBLEM_INDEX = _struct(
    id=T.StringType(), category=T.StringType(), status=T.StringType(), submission=T.StringType()
)

PROBLEM = _struct(
    id=T.StringType(),
    category=T.StringType(),
    prompt=T.StringType(),
    answer=T.StringType(),
    question=T.StringType(),
    examples=T.ArrayType(EXAMPLE),
)

ROLLOUT = _struct(
    row_no=T.LongType(),
    problem_id=T.StringType(),
    category=T.StringType(),
    prompt_token_ids=_INTS,
    completion_token_ids=_INTS,
    text=T.StringType(),
    pred=T.StringType(),
    answer=T.StringType(),
    reward=T.DoubleType(),
    old_logp=_DOUBLES,
    ppl_approx=T.DoubleType(),
    stage=T.StringType(),
)

# One generation request with its sampled completions, before grading.
GENERATION_OUTPUT = _struct(
    problem_id=T.StringType(),
    category=T.StringType(),
    answer=T.StringType(),
    prompt_token_ids=_INTS,
    completions=T.ArrayType(
        _struct(
            token_ids=_INTS,
            text=T.StringType(),
            logprobs=T.ArrayType(T.MapType(T.StringType(), T.DoubleType())),
        )
    ),
)

CORPUS_ROW = _struct(
    problem_id=T.StringType(),
    category=T.StringType(),
    tokens=_INTS,
    mask=_MASK,
    weight=T.DoubleType(),
    sign=T.DoubleType(),
)

CORPUS_INDEX = _struct(
    problem_id=T.StringType(),
    segment=T.StringType(),
    category=T.StringType(),
    masked_token_count=T.LongType(),
    unmasked_token_count=T.LongType(),
    token_count=T.LongType(),
    answer=T.StringType(),
    included=T.BooleanType(),
)

SEGMENT = _struct(problem_id=T.StringType(), pos=T.IntegerType(), type=T.StringType(), tokens=_INTS)

RUN = _struct(
    run=T.StringType(),
    num_prompt_tokens=T.LongType(),
    num_gen_tokens=T.LongType(),
    avg_logprob=T.DoubleType(),
    extracted_answer=T.StringType(),
    correct=T.BooleanType(),
)

GENERATION_RUNS = _struct(id=T.StringType(), num_runs=T.LongType(), runs=T.ArrayType(RUN))

VOCAB = _struct(token_id=T.IntegerType(), token=T.StringType())

RAW_TOKEN = _struct(token_id=T.IntegerType(), logprob=T.DoubleType())

LOG_INDEX = _struct(
    epoch=T.IntegerType(),
    step=T.LongType(),
    problem_id=T.StringType(),
    segment=T.StringType(),
    category=T.StringType(),
    num_loss_tokens=T.LongType(),
    total_loss=T.DoubleType(),
    min_logprob=T.DoubleType(),
)

PREFERENCE_SIDE = _struct(tokens=_INTS, mask=_MASK)

PREFERENCE_PAIR = _struct(problem_id=T.StringType(), chosen=PREFERENCE_SIDE, rejected=PREFERENCE_SIDE)
