"""Schemas of the relations, as DDL."""

WORD = "struct<word:string,start:double,end:double,probability:double>"
TOKEN = "struct<kind:string,zh:string,pinyin:string,confidence:double,source:string,flags:array<string>>"
DOCUMENT = "doc_id string, text string"
CUE = f"doc_id string, pos int, index int, start double, end double, tokens array<{TOKEN}>, vi string"
FINDING = "doc_id string, code string, severity string, cue_index int, message string, line string"
SEGMENT = f"doc_id string, id int, start double, end double, text string, words array<{WORD}>, no_speech_prob double, avg_logprob double"
NAMES = "han string, split array<string>, pinyin array<string>, type string, reason string, count int, vi string"
BLOCK = "doc_id string, block int, index int, index_ok boolean, start double, end double, stamp string, lines array<string>, line_count int, line_no int, vi string, set_aside array<string>"
