"""Schemas of the logical tables, so that text sources are never read by inference."""

from pyspark.sql.types import StructType

RESPONSES = StructType.fromDDL("id long, participantID long, cue string, response1 string, response2 string, response3 string, section string, created_at timestamp")
PARTICIPANTS = StructType.fromDDL("id long, section string, age int, education int, gender string, nativeLanguage string, latitude double, longitude double, created_at timestamp")
CUES = StructType.fromDDL("id long, cue string, section string")
CUE_SET = StructType.fromDDL("cue string, source string")
UNIFIED = StructType.fromDDL("trial_id long, participant_id long, cue string, response_1 string, response_2 string, response_3 string, age int, gender string, datetime timestamp, dataset string")
RELATEDNESS = StructType.fromDDL("word_1 string, word_2 string, rating_original double, source string, rating_normalized double")
LEXICAL_DECISION = StructType.fromDDL("word string, is_word boolean, age_group string, reaction_time double")
SUBTLEX = StructType.fromDDL("word string, count long, zipf_provided double, language string")
POPULATION = StructType.fromDDL("age int, state string, gender string, n int")
EMBEDDING = StructType.fromDDL("word string, vec array<double>")
R_SQUARED = StructType.fromDDL("word_property string, data string, rsq double, ci_lower double, ci_upper double")
COO = StructType.fromDDL("row_id string, col_id string, value double")
EDGES = StructType.fromDDL("src string, dst string, weight long")
