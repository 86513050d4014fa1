"""Schemas of the corpus tables, for reading JSON and streams without inference."""

SPEAKER = "id string, name string, description string, languages array<string>, created_at string"
RECORDING = "speaker_id string, id string, title string, source string, genre string, register string, raw_path string, audio_path string, sha256 string, duration_s double, multi_speaker boolean, date string, rights string, notes string, added_at string"
WORD = "struct<word:string,start:double,end:double,p:double>"
SEGMENT = f"struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double,words:array<{WORD}>>"
TRANSCRIPT = f"recording_id string, source_sha256 string, model string, language string, prompt string, created_at string, duration_s double, text string, segments array<{SEGMENT}>"
UTTERANCE = "speaker_id string, recording_id string, rec_ord int, index int, start double, end double, text string, split string"
ANSWER = "items array<struct<device:string,utterances:array<int>,quote:string,why:string>>"
ANNOTATION = "annotation_id long, speaker_id string, recording_id string, device string, utterances array<int>, quote string, why string, t double"

ISSUE = "struct<metric:string,expected:string,got:string,feedback:string,weight:double>"
DRAFT = f"version_no int, text string, score double, issues array<{ISSUE}>"
GENERATION = f"generation_id string, speaker_id string, instruction string, model string, system string, created_at string, best int, text string, versions array<struct<version_no:int,text:string,score:double,issues:array<{ISSUE}>>>"
CARD = "speaker_id string, lang string, document string, stamp string"
FIND = "struct<device:string,utterances:array<int>,quote:string,why:string>"
ANNOTATED_CHUNK = f"tag string, recording_id string, number int, key string, speaker_id string, items array<{FIND}>"


def top_level(schema: str) -> list[str]:
    """The fields of a schema, without splitting the types of nested ones."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[begin:i].strip())
            begin = i + 1
    return [*out, schema[begin:].strip()]
