"""PySpark-native analytics for physiologic waveforms, annotations and segments."""
