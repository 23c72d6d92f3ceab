"""Explicit schemas of the inputs."""

INPUTS = "id BIGINT, test_prefix STRING, focal_method STRING, docstring STRING"
META = "id BIGINT, GTassert STRING, assertORexception INT"
META_LLM = "id BIGINT, GT_output STRING, file_path STRING, test_name STRING"
META_BUGS = "project STRING, bug_num INT, test_name STRING, exception_lbl BOOLEAN, assertion_lbl STRING, exception_bug INT, assertion_bug INT"
ORACLE_PREDS = "id BIGINT, project STRING, bug_num INT, test_name STRING, test_prefix STRING, except_pred INT, assert_pred STRING, clean_test_prefix STRING"
DECODED = "id BIGINT, target STRING, output STRING, score DOUBLE, exact_match BOOLEAN"
PREDICTIONS = "id BIGINT, test_prefix STRING, prediction STRING, target STRING, exact_match BOOLEAN"
EVAL_PREDICTIONS = "id BIGINT, project STRING, bug_num INT, test_name STRING, test_prefix STRING, predicted_oracle STRING, oracle_type INT, ground_truth_type INT, exception_bug INT, assertion_bug INT"
TEST_DATA = "project STRING, bug_num INT, TP BOOLEAN"
TOKENS = "layout STRING, split STRING, id BIGINT, inputs ARRAY<INT>, outputs ARRAY<INT>, prefix_ids ARRAY<INT>"
METHODS = "content STRING, metadata STRUCT<fpath_tuple: ARRAY<STRING>, name: STRING, class: STRING, start_line_no: INT, end_line_no: INT, return_type: STRING, parameters: ARRAY<STRUCT<type: STRING, name: STRING>>, body_raw: STRING>"
TYPES = "class STRING, relative_path STRING, methods ARRAY<STRING>"
COMMANDS = "project STRING, version STRING, phase STRING, returncode INT, stdout STRING, stderr STRING, success BOOLEAN"
LOSSES = "epoch INT, step INT, loss DOUBLE"
ACCURACIES = "epoch INT, accuracy DOUBLE"
