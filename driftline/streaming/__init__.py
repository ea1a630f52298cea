"""Continuous inputs. The engine has no streaming operators of its own; score_stream runs its row rules on a stream."""
