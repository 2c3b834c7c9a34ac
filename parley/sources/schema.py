"""Explicit schemas of the tables this library reads; nothing is inferred."""

from __future__ import annotations

VOLLEYS = "conv_id string, speaker string, vol_text string"
UTTERANCES = (
    "corp_conv_idx long, conv_id string, speaker string, corp_vol_idx long, conv_vol_idx long, vol_text string, "
    "corp_utt_idx long, conv_utt_idx long, utt_text string"
)
ANNOTATED_TIERED = UTTERANCES + ", t1_label_auto string, t1_expl_auto string, t2_label_auto string, t2_expl_auto string"
ANNOTATED_FLAT = UTTERANCES + ", label_auto string, expl_auto string"
MANUAL = (
    "conv_id string, speaker string, corp_vol_idx long, conv_vol_idx long, corp_utt_idx long, conv_utt_idx long, "
    "utt_text string, t1_label_GT string, t2_label_GT string"
)
THIRD_PARTY = "conv_id string, speaker string, vol_text string, label string"
THIRD_PARTY_FULL = (
    "transcript_id long, utterance_id long, utterance_text string, therapist_input_exists boolean, therapist_input_subtype string, "
    "reflection_exists boolean, reflection_subtype string, question_exists boolean, question_subtype string, "
    "main_therapist_behaviour string, client_talk_type string"
)
OUTCOMES = "participant_id string, status string, pre_confidence double, post_confidence double, week_later_confidence double"
PREDICTIONS = "dataset string, conv_id string, speaker string, utt_text string, human_label string, zero_shot_pred string, fine_tuned_pred string"
EXPERIMENT = (
    "experiment_id string, parser_model string, annotator_model string, annotator_context_mode string, "
    "annotator_num_context_turns int, annotator_class_structure string, fine_tuning_enabled boolean"
)
NORMAL_COLUMNS = ["dataset", "conv_id", "speaker", "utt_text", "t1_label", "t2_label"]
