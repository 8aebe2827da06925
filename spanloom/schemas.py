"""Table layouts that the operators share."""

from __future__ import annotations

SPAN = "struct<s:int,e:int>"
CANDIDATE = "struct<sentence:int,s:int,e:int,text:string,sources:array<string>,priority:int,ref:string,occurrence:string,context:string>"
CANDIDATES = f"doc_id string, window int, {CANDIDATE[7:-1]}"
DISTRIBUTION = "array<struct<k:string,p:double>>"
CRITERIA = "array<struct<key:string,value:string>>"

SENTENCE = f"struct<sentence:int,s:int,e:int,text:string,ref:string,tokens:array<{SPAN}>>"
WINDOW = f"struct<window:int,first:int,last:int,s:int,e:int,state:string,sentences:array<{SENTENCE}>,candidates:array<{CANDIDATE}>>"

#: One pass over a text gives all of these; what a question needs stands together in its window.
SCAN = f"doc_id string, text string, sentences array<{SPAN}>, windows array<{WINDOW}>, errors array<struct<stage:string,where:string,error:string>>"
EXTRACTION = (
    "extraction_class string, extraction_text string, char_interval struct<start_pos:int,end_pos:int>, attributes map<string,string>, confidence double, "
    f"probabilities map<string,double>, attribute_confidence map<string,double>, scores map<string,double>, needs_review boolean, normalized string, kind string, sources array<string>, reason string"
)
ERROR = "stage string, where string, error string"
METRICS = "requests long, questions long, cached_questions long, input_tokens long, cost_usd double, retries long, splits long, windows long, candidates long, latency_s double"
ANNOTATED = f"document_id string, text string, model string, extractions array<struct<{EXTRACTION.replace(' string', ':string').replace(' struct', ':struct').replace(' map', ':map').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array', ':array')}>>"
