"""The shipped rule packs, one rule a line: pattern;;;label. A rule's id is its line number.

The patterns and labels are fixed values: results must equal those of the
format's existing scanners, label for label. The dialect is ECMAScript over bytes;
siftline.functions.dialect rewrites it for Java.
"""

LUA = r"""
RunString\s*\(;;;[CRITICAL] Code Execution (RunString)
CompileString\s*\(;;;[CRITICAL] Code Execution (CompileString)
\bloadstring\s*\(;;;[CRITICAL] Code Execution (loadstring)
BroadcastLua\s*\(;;;[CRITICAL] Server Code Broadcast (BroadcastLua)
SendLua\s*\(;;;[CRITICAL] Client Code Execution (SendLua)
pcall\s*\(\s*RunString;;;[CRITICAL] Protected RunString Call
pcall\s*\(\s*CompileString;;;[CRITICAL] Protected CompileString Call
pcall\s*\(\s*loadstring;;;[CRITICAL] Protected loadstring Call
CompileFile\s*\(;;;[CRITICAL] File Compilation
http\.Fetch\s*\([^)]*function[^)]*RunString;;;[CRITICAL] Remote Code Execution via HTTP Fetch
http\.Post\s*\([^)]*function[^)]*RunString;;;[CRITICAL] Remote Code Execution via HTTP Post
\bgetfenv\s*\(;;;[HIGH] Environment Access (getfenv)
\bsetfenv\s*\(;;;[HIGH] Environment Modification (setfenv)
debug\.getregistry\s*\(;;;[HIGH] Registry Access
debug\.setlocal\s*\(;;;[HIGH] Debug Local Modification
debug\.setupvalue\s*\(;;;[HIGH] Debug Upvalue Modification
debug\.sethook\s*\(;;;[HIGH] Debug Hook Set
_G\s*\[[^\]]+\]\s*=\s*function;;;[HIGH] Dynamic Global Function Assignment
_R\s*=\s*debug\.getregistry;;;[HIGH] Registry Table Access
rawset\s*\(\s*_G\s*,;;;[HIGH] Raw Global Table Modification
game\.ConsoleCommand\s*\(;;;[HIGH] Console Command Execution
RunConsoleCommand\s*\(;;;[HIGH] Console Command Execution
:SetUserGroup\s*\(\s*["'](superadmin|admin)["']\s*\);;;[CRITICAL] Setting User to Admin/Superadmin
http\.Fetch\s*\([^)]*function[^)]*CompileString;;;[CRITICAL] Remote Code Compilation
http\.Post\s*\([^)]*function[^)]*CompileString;;;[CRITICAL] Remote Code Compilation
0[xX][0-9a-fA-F]{16,};;;[HIGH] Very Long Hex String (Obfuscation)
\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2};;;[MEDIUM] Multiple Hex Escapes
["'][A-Za-z0-9+/]{80,}={0,2}["'];;;[HIGH] Base64 Encoded Data (Very Long)
file\.Write\s*\(\s*["'][^"']*\.lua["'];;;[HIGH] Writing Lua File
file\.Delete\s*\(;;;[MEDIUM] File Deletion
sv_allowcslua;;;[CRITICAL] CSLua Setting Access
rcon_password;;;[CRITICAL] RCON Password Access
rcon\s+[a-zA-Z];;;[CRITICAL] RCON Command Execution
assert\s*\(\s*CompileString;;;[CRITICAL] Assert CompileString
assert\s*\(\s*RunString;;;[CRITICAL] Assert RunString
os\.execute\s*\(;;;[CRITICAL] OS Command Execution
io\.popen\s*\(;;;[CRITICAL] Process Pipe Open
io\.open\s*\([^)]*["']w;;;[HIGH] File Write Operation
package\.loadlib\s*\(;;;[CRITICAL] Native Library Load
require\s*\(\s*["']ffi["']\s*\);;;[CRITICAL] FFI Library Load
ffi\.cdef\s*\(;;;[CRITICAL] FFI C Definition
ffi\.load\s*\(;;;[CRITICAL] FFI Library Load
ffi\.C\.;;;[CRITICAL] FFI C Namespace Access
coroutine\.wrap\s*\(\s*function[^)]*RunString;;;[CRITICAL] Coroutine Code Execution
timer\.Simple\s*\([^)]*function[^)]*RunString;;;[CRITICAL] Delayed Code Execution
timer\.Simple\s*\([^)]*function[^)]*http\.Fetch;;;[HIGH] Delayed HTTP Request
hook\.Add\s*\([^)]*function[^)]*RunString;;;[CRITICAL] Hook with Code Execution
net\.Receive\s*\(\s*["'][A-Za-z0-9]{40,}["'];;;[HIGH] Suspicious Network String (Very Long)
util\.AddNetworkString\s*\(\s*["'][A-Za-z0-9]{40,}["'];;;[HIGH] Suspicious Network String (Very Long)
string\.char\s*\(\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+;;;[HIGH] CharCode Obfuscation (5+ chars)
table\.concat\s*\([^)]*string\.char;;;[HIGH] Obfuscated String Building
(_G|_R)\s*\[\s*[^"\]]+\s*\];;;[HIGH] Dynamic Global/Registry Access (Variable Key)
for\s+\w+\s*,\s*\w+\s+in\s+pairs\s*\(\s*debug\.getregistry;;;[HIGH] Iterating Debug Registry
concommand\.Add\s*\([^)]*function[^)]*RunString;;;[CRITICAL] Console Command with RunString
concommand\.Add\s*\([^)]*function[^)]*http;;;[HIGH] Console Command with HTTP
net\.Receive\s*\([^)]*function[^)]*RunString;;;[CRITICAL] Network Receive with RunString
net\.Receive\s*\([^)]*function[^)]*CompileString;;;[CRITICAL] Network Receive with CompileString
util\.JSONToTable\s*\([^)]*RunString;;;[CRITICAL] JSON to RunString
game\.CleanUpMap\s*\(;;;[MEDIUM] Map Cleanup (Potential Abuse)
Entity\s*\(\s*[0-9]+\s*\)\s*:Remove;;;[MEDIUM] Entity Removal by ID
player\.GetAll\s*\(\s*\)[^;]*:Kick;;;[HIGH] Mass Player Kick
player\.GetAll\s*\(\s*\)[^;]*:Ban;;;[CRITICAL] Mass Player Ban
"""

VMT = r"""
[0-9]{2,3}(,[0-9]{2,3}){6,};;;[HIGH] CharCode Sequence (7+ numbers)
\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}\\x;;;[HIGH] Multiple Hex Escapes in VMT
RunString\s*\(;;;[CRITICAL] Code Execution (RunString) in VMT
CompileString\s*\(;;;[CRITICAL] Code Execution (CompileString) in VMT
loadstring\s*\(;;;[CRITICAL] Code Execution (loadstring) in VMT
http\.Fetch\s*\(;;;[CRITICAL] HTTP Fetch in VMT (Suspicious)
http\.Post\s*\(;;;[CRITICAL] HTTP Post in VMT (Suspicious)
debug\.getregistry;;;[CRITICAL] Registry Access in VMT
BroadcastLua\s*\(;;;[CRITICAL] Server Code Broadcast in VMT
SendLua\s*\(;;;[CRITICAL] Client Code Execution in VMT
\bgetfenv\s*\(;;;[CRITICAL] Environment Access in VMT
\bsetfenv\s*\(;;;[CRITICAL] Environment Modification in VMT
_G\s*\[\s*["'];;;[CRITICAL] Global Table Access in VMT
"""

VTF = r"""
RunString\s*\(;;;[CRITICAL] Code Execution (RunString) in VTF
CompileString\s*\(;;;[CRITICAL] Code Execution (CompileString) in VTF
loadstring\s*\(;;;[CRITICAL] Code Execution (loadstring) in VTF
http\.Fetch\s*\(;;;[CRITICAL] HTTP Fetch in VTF (Suspicious)
http\.Post\s*\(;;;[CRITICAL] HTTP Post in VTF (Suspicious)
debug\.getregistry;;;[CRITICAL] Registry Access in VTF
BroadcastLua\s*\(;;;[CRITICAL] Server Code Broadcast in VTF
SendLua\s*\(;;;[CRITICAL] Client Code Execution in VTF
\bgetfenv\s*\(;;;[CRITICAL] Environment Access in VTF
\bsetfenv\s*\(;;;[CRITICAL] Environment Modification in VTF
_G\s*\[\s*["'];;;[CRITICAL] Global Table Access in VTF
[0-9]{2,3}(,[0-9]{2,3}){6,};;;[HIGH] CharCode Sequence (7+ numbers) in VTF
\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}\\x;;;[HIGH] Multiple Hex Escapes in VTF
"""

TTF = r"""
[0-9]{2,3}(,[0-9]{2,3}){6,};;;[HIGH] CharCode Sequence (7+ numbers) in TTF
\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}\\x;;;[HIGH] Multiple Hex Escapes in TTF
RunString\s*\(;;;[CRITICAL] Code Execution (RunString) in TTF
CompileString\s*\(;;;[CRITICAL] Code Execution (CompileString) in TTF
loadstring\s*\(;;;[CRITICAL] Code Execution (loadstring) in TTF
http\.Fetch\s*\(;;;[CRITICAL] HTTP Fetch in TTF (Suspicious)
http\.Post\s*\(;;;[CRITICAL] HTTP Post in TTF (Suspicious)
debug\.getregistry;;;[CRITICAL] Registry Access in TTF
BroadcastLua\s*\(;;;[CRITICAL] Server Code Broadcast in TTF
SendLua\s*\(;;;[CRITICAL] Client Code Execution in TTF
\bgetfenv\s*\(;;;[CRITICAL] Environment Access in TTF
\bsetfenv\s*\(;;;[CRITICAL] Environment Modification in TTF
_G\s*\[\s*["'];;;[CRITICAL] Global Table Access in TTF
"""

PACKS: dict[str, str] = {".lua": LUA, ".vmt": VMT, ".vtf": VTF, ".ttf": TTF}
