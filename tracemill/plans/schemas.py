"""Schemas of the records the engine reads and writes, as DDL."""

SEED = "id string, conversations array<struct<`from`: string, value: string>>, eval struct<answer: string, answer_idx: string>, answer_idx string, reference string"
JUDGED = "id string, input string, gpt_responses array<string>, eval struct<answer: string, answer_idx: string>"
CANDIDATE = "id string, cand_idx int, answer string, score double, steps array<double>"
CHAIN = "array<struct<step: string, value: double, sim: double>>"
TREE_RECORD = f"id string, question string, pos array<struct<chain: {CHAIN}, value: double, sim: double>>, neg array<struct<chain: {CHAIN}, value: double, sim: double>>, answer string, original_dataset string"
SUPERVISED = "id string, conversations array<struct<`from`: string, value: string>>, label double, inter boolean"
PREFERENCE = "prompt array<struct<role: string, content: string>>, chosen array<struct<role: string, content: string>>, rejected array<struct<role: string, content: string>>"
REWARD = "id string, prompt string, completions array<string>, labels array<double>, penalties array<double>"
SCORE = "id string, acc double, pred string, ground_truth string, text_answer string, pass_at_k array<double>, all_acc array<int>"
RESULT = "dataset string, acc double, pass_at_k array<double>"
