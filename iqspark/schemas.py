"""Schemas of the canonical tables; every reader states one of them."""

FLAGS = 8
FRAMES = "stream_id string, seq long, packet_counter long, packet_error int, flags array<int>, i array<int>, q array<int>"
TONE_SAMPLES = "stream_id string, seq long, packet_counter long, tone int, i int, q int"
SIDECAR = "date string, num_tones int, sample_rate double, format string, index_err int, index_cnt int, " + ", ".join(f"index_flag_{k} int" for k in range(FLAGS)) + ", ordering string, system_information map<string,string>"
SWEEP = "sweep_id string, tone int, point int, f double, i double, q double, ei double, eq double"
SWEEP_SAMPLES = "sweep_id string, sample int, point int, tone int, i double, q double, packet_error int"
CALIBRATION = "cal_id string, cal_order long, freq_hz double, value_db double"
TONE_LIST = "Name string, Freq double, `Offset att` double, `All` int, `None` int"
#: What flags 0 to 4 say; 5 to 7 are unused.
FLAG_NAMES = ["server_request", "set_freqs", "set_amps", "set_phases", "cal_freeze"]
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'xx"
