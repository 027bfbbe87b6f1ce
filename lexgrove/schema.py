"""Schemas of the engine's tables. Optional fields are nullable; corpus_pos is the order in which ties are resolved."""

EMAIL = "struct<overview:boolean,n:int,of:int,sender:string,recipient:string,date:string,is_self:boolean,senders:array<string>,self_senders:array<string>>"
FILES = "matter string, file string, ext string, sha256 string, bytes bigint"
SKIPPED = "matter string, file string, ext string, partial boolean, why string"
MANIFEST = "matter string, sidecar string, source string, hash string, empty boolean"
MESSAGES = (
    "file string, pos int, sender string, recipient string, cc string, date string, date_raw string, subject string, subject_inherited boolean,"
    " lines array<string>, attachments array<string>"
)
CHUNKS = f"matter string, file string, chunk_pos int, chunk_id string, heading string, title string, text string, email {EMAIL}, vec array<float>, corpus_pos bigint"
QUESTIONS = "qid bigint, question string, scope string, top_k int, diverse boolean"
AUDIT = (
    "ts string, matter string, qid bigint, question string, only string, top_score double, cos_top double, refused boolean, answer string, warnings array<string>,"
    " model string, latency_s double, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, error string"
)
