from duewise.llm import toxicity


def test_bounds_were_not_lowered_to_fit():
    assert toxicity.MAX_POSITIVE >= 6_000 and toxicity.MAX_UNLABELLED >= 18_000
