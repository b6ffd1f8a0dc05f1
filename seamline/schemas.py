"""Explicit schemas of the engine's tables; nothing is inferred."""

REFERENCE = "struct<kind:string,line:int,name:string,specifier:string,local:string,namespace:boolean,target_chunk_id:string,evidence:string>"
CHUNK = f"id string, file string, language string, kind string, name string, start_line int, end_line int, content string, parent_id string, container_name string, references array<{REFERENCE}>"
SOURCE_FILE = "path string, source string, language string, strategy string, reason string, size bigint"
EDGE = "kind string, from_id string, from_file string, to_id string, to_file string, name string, specifier string, confidence string, evidence string"
TASK_LABEL = "id string, split string, task string, required array<string>, useful array<string>, irrelevant array<string>"
JUDGMENT = "chunk_id string, relevance double"
RECORDING = "version int, model string, sdk_version string, recorded_at string, commit string, tasks map<string, struct<candidate_ids: array<string>, fingerprint: string, judgments: array<struct<chunk_id: string, relevance: double>>, usage: map<string, bigint>, latency_ms: int, requests: array<struct<latency_ms: int, input_tokens: int, output_tokens: int>>>>"
