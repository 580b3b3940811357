"""Stage contracts as DDL."""

FILE_CHANGES = (
    "commit_hash string, author string, message string, date string, parent_commit_hash array<string>, toolchain_content string,"
    " file_path_before string, file_path_after string, content_before string, content_after string, gold_diff string, added_lines int,"
    " total_changes int, pure_changes int, absolute_added_lines int, change_type string, filtered_gold_diff string, filtered_added_lines int,"
    " filtered_total_changes int, filtered_pure_changes int, filtered_absolute_added_lines int, is_split_hunk boolean"
)
EXPANSION = "initial_commits bigint, commit_parent_pairs bigint, file_changes bigint, final_file_changes bigint"
VERIFICATION = (
    "struct<parsed_output:array<struct<type:string,message:string>>,raw_output:string,raw_stderr:string,returncode:int,pass:boolean,complete:boolean,"
    "lean_output:string,system_error:string>"
)
VERIFY_INPUT = "commit_hash string, code string"
STATUS = "commit_id string, status string, message string, updated_at string, extras map<string,string>"
METRICS = "model string, temperature double, n_responses int, k int, pass_at_k double"
SNAPSHOT = "commit_id string, rel_path string, hash string, type string"
STORE = "hash string, content binary"
CHAT_LOG = "id string, timestamp string, model_name string, system_prompt string, prompt string, completion string, thread_id bigint, day string"
RAW_CHANGE = (
    "commit_hash string, author string, message string, date string, parent_commit_hash array<string>, toolchain_content string, parent string,"
    " file_path_before string, file_path_after string, content_before string, content_after string, gold_diff string, copied boolean"
)
