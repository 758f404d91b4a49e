"""The seven rewrite passes, one module each, over segment tables (request_id, seg_idx, role, segment_type, text, token_count)."""
